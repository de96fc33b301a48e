"""SimHash near copies by anchor-point covering.

Two fingerprints of 64 bits that differ in 3 places differ in at most one place of one
of their two halves. In each half, 31 bits are covered by the Hamming code of length 31:
its codewords are the anchors and every value is within radius 1 of exactly one. Each
fingerprint goes to every anchor within radius 1 + 1 = 2 (1 or 16 of them) and is marked
at its nearest. Of a linked pair, the other one is then at the anchor where the first is
marked, so comparing marked with present fingerprints per anchor misses no pair, and
there are 2**26 anchors to a half.

Fingerprints, not documents, are compared: exact copies and texts with the same words
are one. An anchor with many fingerprints is cut into blocks of ``BLOCK`` that meet
pairwise in tasks of their own, and each block returns a spanning forest of its links,
not its pairs. Components are then joined over all blocks.

Defined results: a null or empty text, or one without words, has fingerprint zero;
repeated rows are returned each; null ids are never the smallest; all-null ids give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function
from docloom.llm.decontaminate import free_name
from docloom.llm.graph import components
from docloom.llm.words import blank_words
from docloom.plans.stored import stored

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
HASH_SEED = 42
BLOCK = 2048
#: Shingles whose bits are counted at once.
_CHUNK = 65_536


def fingerprint_of(words: list[bytes], n: int = SHINGLE_WORDS) -> int:
    if not words:
        return 0
    line, width = b" ".join(words), min(n, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        view = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(view, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


@arrow_function(pa.int64())
def fingerprint(text: pa.Array) -> pa.Array:
    """The 64 bits as a signed number."""
    return pa.array([fingerprint_of(blank_words(t)) for t in text.to_pylist()], pa.int64())


def _anchored(prints: DataFrame) -> DataFrame:
    """(half, anchor, near, fp): each fingerprint at every anchor within radius 2."""
    halves = prints.select("fp", F.posexplode(F.array(F.col("fp"), F.shiftright("fp", 32))).alias("half", "bits"))
    halves = halves.withColumn("bits", F.col("bits").bitwiseAND(F.lit(0x7FFFFFFF)))
    syndrome: Column = F.lit(0)
    for b in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)
        odd = F.bit_count(F.col("bits").bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
        syndrome = syndrome + F.shiftleft(odd, b)
    # i = 0: the nearest anchor; else flip places i and i xor syndrome, each pair once
    out = halves.withColumn("s", syndrome).select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    out = out.withColumn("j", F.col("i").bitwiseXOR(F.col("s"))).where("i = 0 OR (s <> 0 AND i < j)")
    flip = lambda place: f"if({place} = 0, 0L, shiftleft(1L, {place} - 1))"
    return out.selectExpr("half", f"bits ^ {flip('i')} ^ {flip('j')} AS anchor", "i = 0 AS near", "fp")


def _forest(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between marked ``x`` and present ``y``, thinned to a spanning forest if they outnumber the nodes."""
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= distance)
    a, b = x[i], y[j]
    differ = a != b
    a, b = a[differ], b[differ]
    if len(a) <= len(x) + len(y):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def links(prints: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` linked within ``distance`` (3 at most).

    Not every pair: per anchor block at most as many edges as it holds fingerprints.
    """
    if distance > MAX_DISTANCE:
        raise ValueError("the anchors cover a distance of at most 3")
    rows = _anchored(prints.select("fp").distinct()).repartition("half", "anchor")
    crowd = rows.groupBy("half", "anchor").agg(F.count("*").alias("n"), F.max("near").alias("marked"))
    crowd = crowd.where("n > 1 AND marked").select("half", "anchor", F.ceil(F.col("n") / block).alias("cells"))
    met = rows.join(crowd, ["half", "anchor"])
    own = F.pmod(F.xxhash64("fp"), F.col("cells"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)
    # marked ones meet present ones in a grid of cells x cells blocks
    marked = met.where("near").select("half", "anchor", own.alias("r"), F.explode(every).alias("c"), F.lit(True).alias("near"), "fp")
    present = met.select("half", "anchor", F.explode(every).alias("r"), own.alias("c"), F.lit(False).alias("near"), "fp")
    key = ["half", "anchor", "r", "c"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            fresh = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            rest = [np.concatenate(both) for both in zip(rest, fresh)] if rest else fresh
            cuts = _runs(rest[:4])
            yield from _edges(rest, cuts[:-1], distance)  # the last run may go on
            rest = [c[cuts[-2] :] for c in rest]
        if rest:
            yield from _edges(rest, _runs(rest[:4]), distance)

    dealt = marked.union(present).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _runs(keys: list[np.ndarray]) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    size = len(keys[0])
    changed = np.zeros(max(size - 1, 0), bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    return [0, *(np.nonzero(changed)[0] + 1).tolist(), size]


def _edges(columns: list[np.ndarray], cuts: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    near, fp = columns[4].astype(bool), columns[5].view(np.uint64)
    found = []
    for start, end in zip(cuts, cuts[1:]):
        marked, prints = near[start:end], fp[start:end]
        if marked.any() and not marked.all():
            found.append(_forest(prints[marked], prints[~marked], distance))
    if found:
        a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def component_ids(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, component_id): the smallest doc_id reachable, for stored ``prints`` (doc_id, fp)."""
    own = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "prints")
    roots = components(links(own, distance)).withColumnRenamed("node", "fp")
    rooted = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    prints = stored(docs.select("doc_id", fingerprint("text").alias("fp")), "simhash")
    return prints.join(component_ids(prints, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group: that of the smallest doc_id, then of the smallest text; columns unchanged.

    The rank filter runs before the shuffle too, so a group holding most rows sends one
    row per task.
    """
    fp, group, rank = (free_name(docs, n) for n in ("fp", "group", "rank"))
    marked = stored(docs.withColumn(fp, fingerprint("text")), "marked")
    prints = marked.select("doc_id", F.col(fp).alias("fp"))
    roots = component_ids(prints, distance).select(F.col("fp").alias(f"_{fp}"), F.col("root").alias(group))
    grouped = marked.join(roots, F.col(fp) == F.col(f"_{fp}")).drop(f"_{fp}")
    order = Window.partitionBy(group).orderBy(F.col("doc_id").asc_nulls_last(), F.col("text"))
    return grouped.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(fp, group, rank)


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
