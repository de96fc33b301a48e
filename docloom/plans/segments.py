"""Ordered computations over keys of any size.

A window partitioned by a key puts the whole key into one task. Here the key is
cut into segments by an expression that grows with the order, so a key holding a
third of all rows still spreads over many tasks. What one segment has to know
about the earlier ones is a small summary per (key, segment); only that summary
is brought together per key. Keys are taken to be non-null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(grain: Sequence[str]) -> Column:
    condition = F.col(grain[0]) == F.col(f"__{grain[0]}")
    for key in grain[1:]:
        condition = condition & (F.col(key) == F.col(f"__{key}"))
    return condition


def carry_in(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    summaries: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Attach to every row what the other segments of its key leave behind.

    ``summaries`` maps an output column to (how, aggregate over one segment).
    ``last`` is the latest non-null value of the earlier segments, ``max``,
    ``min`` and ``sum`` combine the earlier segments, ``any`` is the maximum
    over all segments of the key.
    """
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    fold = {
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "max": lambda c: F.max(c).over(before),
        "min": lambda c: F.min(c).over(before),
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "any": lambda c: F.max(c).over(whole),
    }
    grain = [*keys, segment]
    per_segment = df.groupBy(*grain).agg(*[agg.alias(name) for name, (_, agg) in summaries.items()])
    carried = per_segment.select(
        *[F.col(k).alias(f"__{k}") for k in grain],
        *[fold[how](F.col(name)).alias(name) for name, (how, _) in summaries.items()],
    )
    return df.join(carried, _same(grain), "left").drop(*[f"__{k}" for k in grain])


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    segment: Sequence[Column],
    name: str,
) -> DataFrame:
    """Add the 1-based position of each row inside its key.

    ``segment`` expressions never decrease along ``order``. They set the tasks:
    rows are numbered inside (key, segment) and shifted by the row count of the
    earlier segments. With no keys the numbering is global; the table of segment
    counts is then the only thing one task sees as a whole.
    """
    seg = [f"_seg{i}" for i in range(len(segment))]
    tagged = df.select("*", *[e.alias(s) for e, s in zip(segment, seg)])
    grain = [*keys, *seg]
    earlier = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        .orderBy(*seg)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = tagged.groupBy(*grain).agg(F.count(F.lit(1)).alias("_seg_rows"))
    offsets = counts.select(
        *[F.col(c).alias(f"__{c}") for c in grain],
        F.coalesce(F.sum("_seg_rows").over(earlier), F.lit(0)).alias("_seg_offset"),
    )
    inside = Window.partitionBy(*grain).orderBy(*order)
    return (
        tagged.withColumn("_seg_row", F.row_number().over(inside))
        .join(offsets, _same(grain), "left")
        .withColumn(name, (F.col("_seg_offset") + F.col("_seg_row")).cast("bigint"))
        .drop(*seg, *[f"__{c}" for c in grain], "_seg_row", "_seg_offset")
    )


def shuffled_position(
    df: DataFrame, key: str, seed: int, name: str, digits: int = 5
) -> DataFrame:
    """Position in the order of ``md5(seed:key)``: a repeatable shuffle.

    The leading hex digits cut md5 order into equal parts whatever the keys look
    like, and the table of part counts has at most ``16 ** digits`` rows.
    """
    digest = seeded_digest(F.col(key), seed)
    return position(
        df.withColumn("_shuffle_digest", digest),
        [],
        [F.col("_shuffle_digest"), F.col(key)],
        [F.substring("_shuffle_digest", 1, digits)],
        name,
    ).drop("_shuffle_digest")


def seeded_digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
