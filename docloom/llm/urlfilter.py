"""URL filtering: host and path rules first, then a cascade of Bloom filters over listed keys.

A single Bloom filter blocks some keys that are not listed. As all keys of the corpus are
known, those false positives are too: a second filter encodes them, a third the listed
keys that the second wrongly excuses, and so on until none is left. For every key of the
corpus the first level that lacks it tells exactly whether it is listed. The list itself
is never joined with the pages.

Filters are cut into shards by key hash, so each is small however long the list. Up to
``INLINE_SHARDS`` shards (``SHARD_KEYS`` listed keys each, some bits per key and level)
the whole cascade is a constant of a megabyte or two that the tasks hold. A longer list keeps its
shards in a table, and pages find theirs by shard number; the answers are the same.

Everything is DataFrame functions. Defined results: a null url, or one without ``://``,
has empty host and path, and key null, which is never listed; repeated pages are judged
each; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.stored import stored

#: (verdict, host, path): fixed rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

BITS_PER_KEY = 8
HASHES = 4
SHARD_KEYS = 32_768
INLINE_SHARDS = 32


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(of_host: Column, of_path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((of_host == h) | of_host.endswith(f".{h}")) & of_path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _places(key: Column, level: int, words: int) -> list[Column]:
    """The bit places of a key, from the two halves of one hash."""
    h = F.xxhash64(key, F.lit(level))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + i * high, F.lit(64 * words)) for i in range(HASHES)]


def _has(bits: Column, places: Sequence[Column]) -> Column:
    tests = [F.getbit(F.get(bits, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


class Cascade:
    """Exact membership for the keys it was built over."""

    def __init__(self, universe: DataFrame, shard_keys: int = SHARD_KEYS, inline_shards: int = INLINE_SHARDS):
        """``universe``: (key, listed), every key of the corpus; null keys are left out, listed wins."""
        keys = universe.where("key IS NOT NULL").groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
        keys = stored(keys, "keys")
        self.spark = universe.sparkSession
        self.n_listed = keys.where("listed").count()
        self.shards = max(1, -(-self.n_listed // shard_keys))
        self.inline = self.shards <= inline_shards
        self.tables: list[DataFrame] = []
        self.words: list[int] = []
        while True:
            level = len(self.words)
            side = keys.where(F.col("listed") == F.lit(level % 2 == 0))
            # a key of this side that got past all levels before is in need of this one
            left = side.withColumn("shard", self._shard(F.col("key")))
            if level:
                left = self._with_levels(left, "levels").where(self._first_miss(F.col("key"), F.col("levels")) == level)
            largest = left.groupBy("shard").count().agg(F.max("count")).first()[0]
            if not largest:
                break
            words = -(-largest * BITS_PER_KEY // 64)
            self.tables.append(stored(self._level(left, level, words), "level"))
            self.words.append(words)
            self.packed = stored(self._levels(), "levels")

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("int")

    def _level(self, keys: DataFrame, level: int, words: int) -> DataFrame:
        """(level, shard, bits): one dense array of words per shard."""
        places = keys.select("shard", F.explode(F.array(*_places(F.col("key"), level, words))).alias("p"))
        ones = places.select("shard", F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS int))").alias("bit"))
        blank = self.spark.range(self.shards * words).selectExpr(f"CAST(id div {words} AS int) AS shard", f"CAST(id % {words} AS int) AS word", "0L AS bit")
        filled = ones.union(blank).groupBy("shard", "word").agg(F.bit_or("bit").alias("bit"))
        dense = filled.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bit"))).alias("bits"))
        return dense.select(F.lit(level).alias("level"), "shard", F.col("bits.bit").alias("bits"))

    def _levels(self) -> DataFrame:
        """(shard, levels): the bits of all levels so far; one row with all of them if they are held inline."""
        rows = reduce(DataFrame.union, self.tables)
        packed = rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("level", "bits"))).alias("levels"))
        packed = packed.select("shard", F.col("levels.bits").alias("levels"))
        if not self.inline:
            return packed
        return packed.agg(F.sort_array(F.collect_list(F.struct("shard", "levels"))).alias("all")).select("all.levels")

    def _with_levels(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` (with a column shard) and the levels of each row's shard."""
        if not self.inline:
            return df.join(self.packed.withColumnRenamed("levels", name), "shard", "left")
        return df.withColumn(name, F.get(self.packed.scalar(), F.col("shard")))

    def _first_miss(self, key: Column, levels: Column) -> Column:
        """Number of the first level that lacks the key."""
        miss = F.lit(len(self.words))
        for level in reversed(range(len(self.words))):
            has = _has(F.get(levels, F.lit(level)), _places(key, level, self.words[level]))
            miss = F.when(has, miss).otherwise(F.lit(level))
        return miss

    def listed(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``; exact for keys of the universe and null."""
        if not self.words:
            return df.withColumn(name, F.lit(False))
        columns = df.columns
        found = self._with_levels(df.withColumn("_key", key).withColumn("shard", self._shard(key)), "_levels")
        odd = self._first_miss(F.col("_key"), F.col("_levels")) % 2 == 1
        return found.select(*columns, (F.col("_key").isNotNull() & odd).alias(name))


def addresses(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and the key: host and path together."""
    named = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return named.withColumn("key", F.when(F.col("url").contains("://"), F.concat("host", "path")))


def judge(pages: DataFrame, universe: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **sizes: int) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's, else block for listed keys."""
    named = addresses(pages).withColumn("found", by_rule(F.col("host"), F.col("path"), rules))
    judged = Cascade(universe, **sizes).listed(named, F.col("key"), "listed")
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    """Listed are the addresses met with a tracking parameter; other visits to them are blocked too."""
    universe = addresses(pages).select("key", F.col("url").contains("utm_").alias("listed"))
    return judge(pages, universe)


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path END AS key FROM p),
listed AS (SELECT DISTINCT key FROM k WHERE contains(url, 'utm_') AND key IS NOT NULL),
r AS (
  SELECT k.*, listed.key IS NOT NULL AS is_listed, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
  FROM k LEFT JOIN listed ON k.key = listed.key)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
