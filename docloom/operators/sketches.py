"""Approximate nearest neighbours: multi-probe buckets and bit sketches, set by measured recall.

Vectors are cut into buckets by ``TABLES`` groups of ``HASHES`` random projections; a query looks
into its own cells and into those next to them, nearest cell borders first. A sketch of
``BITS`` projections against thresholds tells for each pair met whether its vectors are worth
comparing. How many cells are opened and how far sketches may differ is not fixed: a bounded
number of queries is answered exactly, and both are raised until that share of their
neighbours is found. Where vectors have so little structure that the cells to open hold most of the
table, the buckets are left out and the sketches alone are compared, cell by cell (``nearest``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

TABLES, HASHES = 8, 6
#: Cells are so many spreads of a projection wide.
WIDTH = 2.0
BITS = 768
#: Rows that spreads are measured on, and queries that recall is measured on.
SAMPLE, MEASURED = 10_000, 64
#: Share of the measured queries' neighbours to be found, and that within sketch distance where cells lose some too.
RECALL, WITHIN = 0.94, 0.965
#: Rows a query would meet in its cells, as a share of the table, from which on sketches are compared without cells.
SCANNED = 0.5

#: Steps to the cells around a cell: 0, +1 or -1 in every projection.
_AROUND = np.array(np.meshgrid(*[[0, 1, -1]] * HASHES, indexing="ij"), np.int32).reshape(HASHES, -1).T


class Projections:
    """Cells and sketches of vectors; drawn for the spreads of ``points``."""

    def __init__(self, points: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(points.shape[1], TABLES * HASHES))
        places = points @ self.lines
        spread = float(places.std(axis=0).mean())
        self.step = WIDTH * spread if spread > 1e-9 * np.abs(places).max() else 1.0 + np.abs(places).max()
        self.shifts = rng.uniform(0, self.step, size=TABLES * HASHES)
        self.bit_lines = rng.normal(size=(points.shape[1], BITS))
        places = points @ self.bit_lines
        self.thresholds = places.mean(axis=0) + 0.25 * places.std(axis=0) * rng.normal(size=BITS)

    def _places(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ self.lines + self.shifts) / self.step).reshape(-1, TABLES, HASHES)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, table, projection)"""
        return np.floor(self._places(vectors)).astype("<i4")

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector the places of all (table, step) in order of the distance to the cell."""
        inside = self._places(vectors)
        inside = inside - np.floor(inside)
        # a step of 0 costs nothing, +1 the way to the upper border, -1 that to the lower one
        costs = np.stack([np.zeros_like(inside), (1 - inside) ** 2, inside**2])
        ways = np.where(_AROUND < 0, 2, _AROUND)
        total = sum(costs[ways[:, h], :, :, h] for h in range(HASHES))  # (step, vector, table)
        return np.argsort(total.transpose(1, 2, 0).reshape(len(vectors), -1), axis=1, kind="stable")

    def sketch(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, word): ``BITS`` bits in 64-bit words."""
        return np.packbits(vectors @ self.bit_lines > self.thresholds, axis=1).view("<i8")


@dataclass
class Setting:
    """What the measured queries ask for."""

    probes: int | None  # cells a query opens, over all tables; None: no cells
    apart: int  # bits two sketches may differ in


@dataclass
class Tuning:
    """Projections and setting for two tables; None where one of them is empty."""

    shape: Projections | None
    setting: Setting | None

    def allowed(self, spark: SparkSession) -> tuple:
        """What tells pairs worth comparing by their sketches alone."""
        return spark.sparkContext.broadcast(self.shape), self.setting.apart


def draw(held: DataFrame, seed: int) -> tuple[Projections, np.ndarray]:
    """Projections for a bounded sample of the table, which does not depend on its partitions."""
    some = held.orderBy(F.xxhash64("embedding"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
    points = np.array(some.column("embedding").to_pylist(), dtype=float)
    return Projections(points, seed), points


def measure(shape: Projections, points: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Setting:
    """The least setting that finds ``RECALL`` of ``pairs``: query vectors, each with its exact neighbours."""
    ranks, apart, cost = [], [], np.zeros(TABLES * len(_AROUND))
    number = {step.tobytes(): i for i, step in enumerate(_AROUND)}
    everywhere = shape.cells(points)
    for query, near in pairs:
        own, order = shape.cells(query[None])[0], shape.order(query[None])[0]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for steps in shape.cells(near) - own:
            opened = [rank[t * len(_AROUND) + number[s.tobytes()]] for t, s in enumerate(steps) if s.tobytes() in number]
            ranks.append(min(opened, default=len(order)))
        differ = shape.sketch(near) ^ shape.sketch(query[None])
        apart += np.bitwise_count(differ.view("<u8")).sum(axis=1).tolist()  # of signed numbers it would count the absolute value's bits
        for t in range(TABLES):
            for step, n in zip(*np.unique(everywhere[:, t] - own[t], axis=0, return_counts=True)):
                if step.tobytes() in number:
                    cost[rank[t * len(_AROUND) + number[step.tobytes()]]] += n / len(points) / len(pairs)
    allowed = int(np.quantile(apart, WITHIN, method="higher"))
    found = np.sort([r for r, a in zip(ranks, apart) if a <= allowed])
    probes = int(found[min(int(np.ceil(RECALL * len(ranks))), len(found)) - 1]) + 1
    # a row counts for each cell it is met in; neighbours may also lie further off than the cells around
    if probes > len(cost) or cost[:probes].sum() >= SCANNED:
        return Setting(None, int(np.quantile(apart, RECALL, method="higher")))
    return Setting(probes, allowed)


def _words() -> StructType:
    return StructType([StructField(f"w{i}", LongType()) for i in range(BITS // 64)])


def _sketches(words: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(w)) for w in words.T], [f"w{i}" for i in range(words.shape[1])])


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)


def sketched(rows: DataFrame, shape: Projections, name: str) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(shape)

    @F.arrow_udf(_words())
    def sketch(vectors: pa.Array) -> pa.Array:
        return _sketches(shipped.value.sketch(_vectors(vectors)))

    return rows.withColumn(name, sketch("embedding"))


def bucketed(rows: DataFrame, shape: Projections, probes: int | None = None) -> DataFrame:
    """``rows`` once for each cell: their own one in each table, or the first ``probes`` around a query."""
    shipped = rows.sparkSession.sparkContext.broadcast(shape)

    @F.arrow_udf(ArrayType(BinaryType()))
    def cells(vectors: pa.Array) -> pa.Array:
        x = _vectors(vectors)
        own = shipped.value.cells(x)
        if probes is None:
            return pa.array([[bytes([t]) + cell.tobytes() for t, cell in enumerate(row)] for row in own], pa.list_(pa.binary()))
        out = []
        for row, order in zip(own, shipped.value.order(x)):
            table, step = np.divmod(order[:probes], len(_AROUND))
            out.append([bytes([t]) + cell.tobytes() for t, cell in zip(table, row[table] + _AROUND[step])])
        return pa.array(out, pa.list_(pa.binary()))

    return rows.withColumn("bucket", F.explode(cells("embedding")))


def apart(one: str, other: str) -> Column:
    """Bits in which two sketches differ."""
    differ = [F.bit_count(F.col(f"{one}.w{i}").bitwiseXOR(F.col(f"{other}.w{i}"))) for i in range(BITS // 64)]
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return total
