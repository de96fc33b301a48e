"""Bloom filters as tables, so that a long column can be tested without being shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A shard has so many keys, about, so many bits and so many bits per key: wrong for one other key in 1,500.
SHARD_KEYS, SHARD_BITS, PROBES = 32_768, 1 << 19, 8
#: A filter for so many keys has 1,024 shards of 64 KiB and is the largest that is broadcast.
MOST_KEYS = 1024 * SHARD_KEYS


def _shards(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(shards)).cast("int")


def _bits(key: str) -> Column:
    """The bits of a key inside its shard."""
    first = F.pmod(F.xxhash64(F.lit(1), key), F.lit(SHARD_BITS))
    step = F.pmod(F.xxhash64(F.lit(2), key), F.lit(SHARD_BITS)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(first + i * step, F.lit(SHARD_BITS)))


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """(shard, words): the filter of all non-null ``key`` values, about ``n_keys`` of them."""
    shards, words = _shards(n_keys), SHARD_BITS // 64
    bits = keys.where(F.col(key).isNotNull()).select(_shard(key, shards).alias("shard"), F.explode(_bits(key)).alias("bit"))
    used = bits.select("shard", F.expr("CAST(bit DIV 64 AS INT)").alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("value"))
    every = keys.sparkSession.range(shards * words).selectExpr(
        f"CAST(id DIV {words} AS INT) AS shard", f"CAST(id % {words} AS INT) AS word", "0L AS value"
    )
    dense = used.unionByName(every).groupBy("shard", "word").agg(F.bit_or("value").alias("value"))
    listed = dense.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "value"))).alias("words"))
    return listed.select("shard", F.col("words.value").alias("words"))


def may_hold(rows: DataFrame, key: str, filter_: DataFrame, n_keys: int) -> DataFrame:
    """Rows of ``rows`` whose ``key`` may be in the filter; those that are, surely. Nothing is shuffled."""
    if n_keys > MOST_KEYS:
        raise ValueError(f"a filter of {n_keys} keys is too large to broadcast")
    held = filter_.select(F.col("shard").alias("__shard"), F.col("words").alias("__words"))
    tested = rows.join(F.broadcast(held), _shard(key, _shards(n_keys)) == F.col("__shard"))
    hit = F.forall(
        _bits(key),
        lambda bit: F.get("__words", F.floor(bit / 64).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
        )
        != 0,
    )
    return tested.where(hit).drop("__shard", "__words")
