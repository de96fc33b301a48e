"""Benchmark decontamination: one Aho-Corasick automaton over test questions and answers.

Benchmark texts are cut into windows of consecutive words. The windows, joined by
single blanks, are the patterns of one automaton; every document is normalised the
same way and run through it once. Hits come back as word positions and as character
offsets of the original text.

Memory: an automaton holds windows of ``AUTOMATON_CHARS`` characters at most. A larger
benchmark is dealt over several automata by window hash; the documents then pass one
after the other, each pass merging its hits into the stored result of the former.

Defined results: a null or empty text has no words and is never contaminated; items
with null id or null text take no part; an item given twice counts once; repeated
document rows are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import WORD_SPANS, letter_words
from docloom.plans.stored import stored

WINDOW_WORDS = 13
AUTOMATON_CHARS = 4_000_000
#: A document is contaminated if it is hit and at least one word in so many is.
HIT_SHARE = 20

_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("chars", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_FOUND_SQL = (
    "n_words bigint, words array<struct<start: bigint, end: bigint>>, "
    "chars array<struct<start: bigint, end: bigint>>, items array<string>"
)


def windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows of all items with the ids of the items that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = letter_words(text)
                cuts = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} - {b""}
                ids += [item] * len(cuts)
                found += cuts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").dropna()
    return items.mapInArrow(cut, "item string, window binary").groupBy("window").agg(F.collect_set("item").alias("items"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanner(spark, rows: list) -> object:
    """A column function that adds the hits of these windows to those found before."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, row in enumerate(rows):
        automaton.add_word(f" {bytes(row.window).decode('latin-1')} ", i)
    automaton.make_automaton()
    shipped = spark.sparkContext.broadcast((automaton, [(bytes(r.window).count(b" ") + 1, list(r["items"])) for r in rows]))

    @F.arrow_udf(_FOUND_SQL)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        automaton, patterns = shipped.value
        out = []
        for t, old in zip(text.to_pylist(), before.to_pylist()):
            words = letter_words(t)
            spans, found = [], set()
            if words and len(automaton):
                starts: list[int] = []
                line = f" {b' '.join(words).decode('latin-1')} "
                for end, i in automaton.iter(line):
                    if not starts:  # of each word in the normalised line
                        at = 1
                        for word in words:
                            starts.append(at)
                            at += len(word) + 1
                    last = bisect.bisect_left(starts, end)  # the match ends on the blank behind its last word
                    spans.append((last - patterns[i][0], last))
                    found.update(patterns[i][1])
            out.append((words, spans, found, t, old))
        return pa.array([_row(*x) for x in out], _FOUND)

    return scan


def _row(words: list, spans: list, found: set, text: str | None, old: dict | None) -> dict:
    if old:
        spans = spans + [(x["start"], x["end"]) for x in old["words"]]
        found = found | set(old["items"])
    spans = _merged(spans)
    chars: list[tuple[int, int]] = []
    if spans:
        places = [m.span() for m in WORD_SPANS.finditer(text)]
        chars = [(places[a][0], places[b - 1][1]) for a, b in spans]
    pairs = lambda xs: [{"start": a, "end": b} for a, b in xs]
    return {"n_words": len(words), "words": pairs(spans), "chars": pairs(chars), "items": sorted(found)}


def contamination(
    docs: DataFrame, benchmark: DataFrame, name: str, n: int = WINDOW_WORDS, automaton_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, hit word spans, their characters, items.

    Other columns stay, whatever their names; ``name`` must be free.
    """
    spark = docs.sparkSession
    cuts = stored(windows(benchmark, n).withColumn("size", F.length("window") + 16 * F.size("items")), "windows")
    total = cuts.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // automaton_chars))
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{_FOUND_SQL}>"))
    for block in range(blocks):
        rows = cuts.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window", "items").collect()
        out = out.withColumn(name, _scanner(spark, rows)(F.col("text"), F.col(name)))
        if block < blocks - 1:
            out = stored(out, "hits")
    return out


def n_hit(found: str) -> Column:
    return F.aggregate(F.col(f"{found}.words"), F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def contaminated(found: str, share: int = HIT_SHARE) -> Column:
    return (n_hit(found) > 0) & (share * n_hit(found) >= F.col(f"{found}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, columns unchanged."""
    name = free_name(docs, "found")
    return contamination(docs, benchmark, name).where(~contaminated(name)).drop(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark, "found").select("doc_id", "found")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit("found").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated("found").alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
cuts AS (
  SELECT DISTINCT item, least(len(w), {WINDOW_WORDS}) AS n, array_to_string(w[i + 1 : i + {WINDOW_WORDS}], ' ') AS s
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - {WINDOW_WORDS - 1}))) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM cuts) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM runs JOIN cuts USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
