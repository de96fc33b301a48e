"""Exact squared distances of all queries and chunks, in cells of bounded size.

Queries are dealt over rows of cells and chunks over columns; each cell is one group, whose matrix
product names the few pairs that can be among the k nearest. Only these get their distance, summed as
``squared_l2`` sums it, and only k per query leave the cell. Comparing everything stays quadratic; memory
is that of a cell, and cells are spread over all tasks. Where ``allowed`` gives sketches and the bits they may
differ in, only pairs within it count.

A vector with a null component, or of another length, is at distance null, which comes first, as in Spark's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.sketches import Projections

#: Rows of the two sides in a cell, about.
QUERIES, CHUNKS = 4096, 16_384
#: Pairs of which a matrix is held, and pairs whose components are.
_MATRIX, _GAPS = 1 << 20, 1 << 16


def nearest(asked: DataFrame, held: DataFrame, k: int, shards: int | None = None, allowed=None) -> DataFrame:
    """(query_id, chunk_id, distance): each query's k nearest chunks of every cell, or more."""

    def search(left: pa.Table, right: pa.Table) -> Iterator[list]:
        for queries, x, whole, chunks, y, full, mask in _blocks(left, right, allowed):
            yield from _found(queries, x, whole, chunks, y, full, mask, k)

    return _in_cells(asked, held, shards, search, ", distance double")


def pairs_within(asked: DataFrame, held: DataFrame, allowed, shards: int | None = None) -> DataFrame:
    """(query_id, chunk_id) whose sketches differ in no more bits than ``allowed`` says."""

    def search(left: pa.Table, right: pa.Table) -> Iterator[list]:
        for queries, _, _, chunks, _, _, mask in _blocks(left, right, allowed):
            q, c = np.nonzero(mask)
            yield [queries[q], chunks[c]]

    return _in_cells(asked, held, shards, search, "")


def _in_cells(asked: DataFrame, held: DataFrame, shards: int | None, search: Callable, more: str) -> DataFrame:
    across = max(1, -(-held.count() // CHUNKS)) if shards is None else shards
    down = -(-asked.count() // QUERIES)
    number = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    # new names, as both sides may come from one table
    own = lambda name, new: F.col(name).alias(new)
    left = asked.select(own("query_id", "id"), own("embedding", "vector"), number(down, "query_id", "embedding").alias("down"), every(across).alias("across"))
    right = held if down else held.limit(0)
    right = right.select(own("chunk_id", "id"), own("embedding", "vector"), number(across, "chunk_id", "embedding").alias("across"), every(down).alias("down"))
    types = [f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("query_id", asked), ("chunk_id", held))]

    def cell(one: pa.Table, other: pa.Table) -> pa.Table:
        # in the order of their ids, so that equal distances keep the smaller one
        other = other.take(pc.sort_indices(other, sort_keys=[("id", "ascending")], null_placement="at_start"))
        ids = one["id"].combine_chunks(), other["id"].combine_chunks()
        names = ["query_id", "chunk_id", "distance"]
        batches = []
        for q, c, *distance in search(one, other):
            columns = [ids[0].take(pa.array(q)), ids[1].take(pa.array(c)), *distance]
            batches.append(pa.RecordBatch.from_arrays(columns, names[: len(columns)]))
        if not batches:
            columns = [ids[0][:0], ids[1][:0], pa.array([], pa.float64())][: 3 if more else 2]
            batches.append(pa.RecordBatch.from_arrays(columns, names[: len(columns)]))
        return pa.Table.from_batches(batches)

    groups = (side.groupBy("down", "across") for side in (left, right))
    return next(groups).cogroup(next(groups)).applyInArrow(cell, ", ".join(types) + more)


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length to (places of its rows, their vectors, whether they are without nulls)."""
    lists = table["vector"].combine_chunks()
    if not len(lists):
        return {}
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    gaps = np.concatenate([[0], np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))])
    out = {}
    for n in np.unique(np.diff(ends)).tolist():
        at = np.nonzero(np.diff(ends) == n)[0]
        out[n] = at, values[ends[at][:, None] + np.arange(n)], gaps[ends[at + 1]] == gaps[ends[at]]
    return out


def _blocks(left: pa.Table, right: pa.Table, allowed) -> Iterator[tuple]:
    """Blocks of queries against chunks of one length, with the pairs that count; other lengths are chunks that are not whole."""
    shape, apart = (allowed[0].value, allowed[1]) if allowed else (None, None)
    chunks = _by_length(right)
    for n, (queries, x, whole) in _by_length(left).items():
        for m, (others, y, full) in chunks.items():
            if m != n:
                x_, y, full = x[:, :0], y[:, :0], np.zeros(len(y), bool)
            else:
                x_ = x
            step = max(1, _MATRIX // len(others))
            words = _sketches(shape, y) if allowed else None
            for a in range(0, len(queries), step):
                mask = _differ(_sketches(shape, x[a : a + step]), words) <= apart if allowed else None
                yield queries[a : a + step], x_[a : a + step], whole[a : a + step], others, y, full, mask


def _sketches(shape: Projections, vectors: np.ndarray) -> np.ndarray:
    """(word, vector)"""
    return np.ascontiguousarray(shape.sketch(vectors).view("<u8").T)


def _differ(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    total = np.zeros((one.shape[1], other.shape[1]), np.uint16)
    bits, count = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
    for a, b in zip(one, other):
        total += np.bitwise_count(np.bitwise_xor(a[:, None], b, out=bits), out=count)
    return total


def _found(queries, x, whole, chunks, y, full, mask, k: int) -> Iterator[list]:
    """Columns (place of the query, place of the chunk, distance) of the k nearest that count, nulls apart."""
    known = np.ones((len(x), len(y)), bool) if mask is None else mask
    if not (whole.all() and full.all()):
        both = whole[:, None] & full
        q, c = np.nonzero(known & ~both)
        few = _first(q, k)
        if len(few):
            yield [queries[q[few]], chunks[c[few]], pa.nulls(len(few), pa.float64())]
        known = known & both

    with np.errstate(all="ignore"):
        own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
        about = (-2 * x) @ y.T
        about += own[:, None]
        about += other
        about[~known] = np.inf
        # what rounding may make of two sums; nothing is left out where that is not finite
        slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (own + other[full].max(initial=0))
        if len(y) > k:
            limit = np.partition(about, k - 1, axis=1)[:, k - 1] + slack
            known &= ~(about > limit[:, None])
        q, c = np.nonzero(known)
        distance = np.zeros(len(q))
        for a in range(0, len(q), _GAPS):
            gaps = x[q[a : a + _GAPS]] - y[c[a : a + _GAPS]]
            for column in gaps.T:
                distance[a : a + _GAPS] += column * column
    order = np.lexsort((c, distance, q))
    q, c, distance = q[order], c[order], distance[order]
    few = _first(q, k)
    if len(few):
        yield [queries[q[few]], chunks[c[few]], pa.array(distance[few])]


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group in sorted ``groups``."""
    starts = np.searchsorted(groups, groups)
    return np.nonzero(np.arange(len(groups)) - starts < k)[0]
