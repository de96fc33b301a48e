"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: every node halves its sample points at the median of
their projection on the line between two of them. Below the sample's depth, leaves are cut
further by random projections through their own mean, until a leaf holds about ``LEAF_ROWS``
rows of the whole table. Every row is indexed in every tree. A query walks all trees with
one priority queue, nearest boundary first, until it has opened as many leaves as the table
asks for; their rows are ranked by exact cosine. That number is measured: ``PROBES`` of the queries
are compared with the whole table, and as many leaves are opened as hold ``RECALL`` of their
neighbours, ``SEARCH / LEAF_ROWS`` at least.

Rows and queries meet per (tree, leaf) in cells of ``CELL`` rows by ``CELL`` queries, so a
leaf that took a third of the table is many tasks. Equal vectors are one index entry with
the smallest ids, as many as a result can need. The forest is broadcast; its size follows from
``SAMPLE`` and ``TREES`` alone.

The work depends on the data. On directions without any structure a query has to
open a fixed share of the table whatever the index; the README has measured figures.

Defined results: vectors null, zero, with null or non-finite components, of another length than
most, or without an id take no part; an id given with several vectors counts with each,
a pair by its best score; a query never finds its own id; fewer candidates give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import stored

TREES = 8
SAMPLE = 16_384
#: Sample points in a trained leaf, at least.
SAMPLE_LEAF = 8
LEAF_ROWS = 128
#: Rows a query looks at, over all trees, at least.
SEARCH = 40_000
#: Queries whose neighbours are known, and the share of these that has to be in the opened leaves.
PROBES = 128
RECALL = 0.93
CELL = 2048
SEED = 1


class Forest:
    """``trees`` trees of ``trained`` levels with hyperplanes of their own and ``extra`` below them."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, seed: int):
        levels = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows))))
        self.trained = min(levels, max(0, int(np.log2(max(len(sample), 1) / SAMPLE_LEAF))))
        self.extra = levels - self.trained
        self.width = sample.shape[1]
        rng, nodes = np.random.default_rng(seed), 2**self.trained - 1
        self.normal = np.zeros((trees, nodes, self.width))
        self.cut = np.zeros((trees, nodes))
        self.below = rng.normal(size=(trees, self.extra, self.width)) / np.sqrt(self.width)
        self.below_cut = np.zeros((trees, nodes + 1, self.extra))
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for node in range(nodes):
                own = sample[at == node]
                a, b = own[rng.choice(len(own), 2)] if len(own) else np.zeros((2, self.width))
                line = a - b
                if not line.any():
                    line = rng.normal(size=self.width)
                self.normal[t, node] = line / np.linalg.norm(line)
                side = own @ self.normal[t, node]
                self.cut[t, node] = np.median(side) if len(own) else 0.0
                at[at == node] = 2 * node + 1 + (side > self.cut[t, node])
            for leaf in range(nodes + 1):
                own = sample[at == nodes + leaf]
                if len(own):
                    self.below_cut[t, leaf] = own.mean(axis=0) @ self.below[t].T

    def route(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.empty((len(x), len(self.normal)), np.int64)
        for t, (normal, cut) in enumerate(zip(self.normal, self.cut)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.trained):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normal[node]) > cut[node])
            leaf = trained = node - (2**self.trained - 1)
            for e in range(self.extra):
                leaf = 2 * leaf + (x @ self.below[t, e] > self.below_cut[t, trained, e])
            out[:, t] = leaf
        return out

    def search(self, x: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The first ``leaves`` (tree, leaf) of one query, nearest boundaries first."""
        depth = self.trained + self.extra
        side = self.normal @ x - self.cut
        below = self.below @ x
        queue = [(0.0, t, 0, 0) for t in range(len(self.normal))]  # distance, tree, level, path
        found = []
        while queue and len(found) < leaves:
            far, t, level, path = heapq.heappop(queue)
            while level < depth:
                if level < self.trained:
                    margin = side[t, path + 2**level - 1]
                else:
                    e = level - self.trained
                    margin = below[t, e] - self.below_cut[t, path >> e, e]
                near, level = int(margin > 0), level + 1
                heapq.heappush(queue, (max(far, abs(margin)), t, level, 2 * path + 1 - near))
                path = 2 * path + near
            found.append((t, path))
        return found


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that can take part, components as floats of the table."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists("embedding", lambda c: c != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where((F.size("embedding") > 0) & sound & some)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS, search: int | None = None, cell: int = CELL, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found among ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # equal vectors: one entry with the k + 1 smallest ids; the rank filter runs before the shuffle too
    nth = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = stored(entries.withColumn("entry", F.element_at("ids", 1)), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    picked = entries.orderBy(F.xxhash64("entry"), "entry", "embedding").limit(sample).select("embedding").toArrow()
    flat = picked.column("embedding").combine_chunks()
    width = len(flat[0])
    forest = Forest(_unit(flat, width), n, trees, leaf_rows, seed)
    shipped = spark.sparkContext.broadcast(forest.__dict__)

    def planted() -> Forest:
        out = Forest.__new__(Forest)
        out.__dict__ = shipped.value
        return out

    if search is None:
        probes = usable(queries).where(F.size("embedding") == width).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PROBES)
        depths = np.sort(_depths(entries, probes.select("vec_id", "embedding").toArrow(), k, width, planted))
        enough = int(depths[int(np.ceil(RECALL * len(depths))) - 1]) if len(depths) else 0
        opened = max(1, SEARCH // leaf_rows, enough)
    else:
        opened = max(1, search // leaf_rows)

    @F.arrow_udf("array<bigint>")
    def route(vector: pa.Array) -> pa.Array:
        return pa.array(list(planted().route(_unit(vector, width))), pa.list_(pa.int64()))

    @F.arrow_udf("array<struct<tree: int, leaf: bigint>>")
    def look(vector: pa.Array) -> pa.Array:
        grown = planted()
        found = [[{"tree": t, "leaf": p} for t, p in grown.search(x, opened)] for x in _unit(vector, width)]
        return pa.array(found, pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int64())])))

    indexed = entries.select("entry", "ids", "embedding", F.posexplode(route("embedding")).alias("tree", "leaf"))
    asked = usable(queries).where(F.size("embedding") == width).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.select("query_id", "embedding", F.explode(look("embedding")).alias("at")).select("query_id", "embedding", "at.*")
    indexed, asked = stored(indexed, "indexed"), stored(asked, "asked")

    # cells of a leaf: rows by queries
    wanted = asked.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / cell).alias("cs"))
    held = indexed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / cell).alias("rs"))
    grid = wanted.join(held, ["tree", "leaf"])
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    key = ["tree", "leaf", "r", "c"]
    left = indexed.join(grid, ["tree", "leaf"]).withColumn("r", F.pmod(F.xxhash64("entry"), F.col("rs"))).withColumn("c", every("cs"))
    right = asked.join(grid, ["tree", "leaf"]).withColumn("c", F.pmod(F.xxhash64("query_id"), F.col("cs"))).withColumn("r", every("rs"))
    both = left.select(*key, F.lit(False).alias("ask"), F.col("entry").alias("id"), "ids", "embedding").union(
        right.select(*key, F.lit(True), F.col("query_id"), F.array(), "embedding")
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k + 1)
        run, block, names = None, None, None  # the current cell's rows
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                x, here = _unit(batch.column(7).slice(a, b - a), width), keys[a, :4].tolist()
                ids = batch.column(5).slice(a, b - a).to_numpy()
                if keys[a, 4]:
                    if run == here:
                        best.add(ids, x @ np.concatenate(block).T, np.concatenate(names))
                elif run == here:
                    block.append(x)
                    names.append(ids)
                else:
                    run, block, names = here, [x], [ids]
            yield from best.flush(500_000)
        yield from best.flush(0)

    # the table of rows is sorted before the queries of its cell
    dealt = both.repartition(*key).sortWithinPartitions(*key, "ask")
    met = dealt.mapInArrow(rank, "query_id bigint, entry bigint, score double")
    met = met.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    few = met.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1)
    named = few.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _depths(entries: DataFrame, probes: pa.Table, k: int, width: int, planted) -> np.ndarray:
    """How many leaves a probe has to open for each of its ``k`` nearest entries, known by comparing it with all."""
    if not len(probes):
        return np.zeros(0, np.int64)
    asked, own = _unit(probes.column("embedding").combine_chunks(), width), probes.column("vec_id").to_numpy()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            scores = asked @ _unit(batch.column(1), width).T
            scores[own[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            best = np.argsort(-scores, axis=1)[:, :k]
            probe = np.repeat(np.arange(len(asked)), best.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe), pa.array(np.take_along_axis(scores, best, 1).ravel()), batch.column(1).take(pa.array(best.ravel()))], ["probe", "score", "embedding"]
            )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = planted()
        for batch in batches:
            for probe, near in zip(batch.column(0).to_pylist(), batch.column(1)):
                leaves = grown.route(_unit(near.values, width))
                found = grown.search(asked[probe], len(grown.normal) << grown.trained + grown.extra)
                at = {leaf: i + 1 for i, leaf in enumerate(found)}
                need = [min(at[t, int(leaf)] for t, leaf in enumerate(row)) for row in leaves]
                yield pa.RecordBatch.from_arrays([pa.array(need, pa.int64())], ["need"])

    kind = entries.schema["embedding"].dataType.simpleString()
    # an entry of a probe's own vector counts for others of its ids only in the search itself
    met = entries.select("entry", "embedding").mapInArrow(ranked, f"probe bigint, score double, embedding {kind}").where("score > double('-infinity')")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "embedding"))
    near = met.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("probe").agg(F.collect_list("embedding").alias("near"))
    return near.mapInArrow(opened, "need bigint").toArrow().column(0).to_numpy()


class _Best:
    """The best few entries of each query met in a task."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, queries: np.ndarray, scores: np.ndarray, entries: np.ndarray) -> None:
        k = min(self.k, len(entries))
        # equal scores at the edge are all looked at, so that the smaller id wins
        edge = np.partition(scores, len(entries) - k, axis=1)[:, len(entries) - k]
        i, j = np.nonzero(scores >= edge[:, None])
        self._keep(queries[i], scores[i, j], entries[j])

    def _keep(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 200_000:
            self._thin()

    def _thin(self) -> None:
        if not self.parts:
            return
        q, s, e = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((e, -s, q))
        q, s, e = q[order], s[order], e[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (e[1:] != e[:-1])  # found in several trees
        q, s, e = q[fresh], s[fresh], e[fresh]
        start = np.concatenate([[0], np.nonzero(q[1:] != q[:-1])[0] + 1]) if len(q) else np.zeros(0, int)
        nth = np.arange(len(q)) - np.repeat(start, np.diff([*start, len(q)]))
        self.parts = [(q[nth < self.k], s[nth < self.k], e[nth < self.k])]
        self.size = len(self.parts[0][0])

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size > least:
            self._thin()
        if self.size > least:
            for q, s, e in self.parts:
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(e), pa.array(s)], ["query_id", "entry", "score"])
            self.parts, self.size = [], 0


def digest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
