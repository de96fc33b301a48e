"""Vocabulary and token rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.functions.arrays import IGNORED_LABEL, MAX_BATCH_LENGTH, attention_mask, padded
from docloom.functions.metrics import BLANK_RUN
from docloom.plans.segments import position, shuffled_position
from docloom.plans.stored import stored

# Ids below FIRST_WORD_ID are special.
PAD_ID, EOS_ID, BOS_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4

# Words with a rank below this are looked up by a broadcast table of at most
# this many rows. Any other word is then less frequent than all of them, so no
# join key of the shuffled lookup can hold more than 1/HEAD_WORDS of the tokens.
HEAD_WORDS = 20_000


#: Distinct words a task counts before it hands them on.
FLUSH = 200_000


def words(text: Column) -> Column:
    """Whitespace separated words in order, as ``str.split`` gives them."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def count_words(lines: DataFrame, text: str) -> DataFrame:
    """(word, n) over all lines; tasks count first, so only their distinct words are shuffled."""

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                seen.update((line or "").split())
                if len(seen) > FLUSH:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    return lines.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocab(lines: DataFrame, text: str = "input") -> DataFrame:
    """(word, n, token_id): ids by falling frequency, ties by the md5 of the word.

    The md5 tie rule lets the many rare words be numbered in parallel: words of
    one frequency are cut by digest prefix, and only the counts per (frequency,
    prefix) meet in one place.
    """
    counts = count_words(lines, text).withColumn("digest", F.md5("word"))
    by_frequency = [-F.col("n"), F.col("digest"), F.col("word")]
    rare = F.when(F.col("n") < 100, F.substring("digest", 1, 3)).otherwise("")
    ranked = position(counts, [], by_frequency, [-F.col("n"), rare], "rank")
    return ranked.select("word", "n", (F.col("rank") + (FIRST_WORD_ID - 1)).alias("token_id"))


#: Marks a word of a line that is not in the dictionary.
OPEN = -1
_PLACED = "struct<token_at: int, token: int>"
_OPEN_WORDS = ArrayType(StructType([StructField("token_at", IntegerType()), StructField("word", StringType())]))


@F.arrow_udf(ArrayType(IntegerType()))
def _filled(found: pa.Array, placed: pa.Array) -> pa.Array:
    """Begin and end markers around a line's ids, its open places filled; lines of one key are merged by place, then id."""
    out = []
    for i in range(len(found)):
        lines, rest = found[i].values, placed[i].values
        at, token = (rest.field(k).to_numpy() for k in (0, 1))
        known = [lines[j].values.to_numpy() for j in range(len(lines))]
        if len(known) == 1:
            ids = known[0].copy()
            ids[at] = token
        else:
            at = np.concatenate([*[np.nonzero(k != OPEN)[0] for k in known], at])
            token = np.concatenate([*[k[k != OPEN] for k in known], token])
            ids = token[np.lexsort([token, at])]
        out.append(np.concatenate([[BOS_ID], ids, [EOS_ID]]).astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def encode_tokens(
    lines: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    text: str = "input",
    with_mask: bool = False,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """(keys, input_ids[, attention_mask]) with begin and end markers around each line.

    ``keys`` identify a line; lines of equal keys become one, by position. ``vocab`` is read twice and should
    be a stored table. Frequent words are found in a bounded dictionary that each task holds, and a line's ids stay
    one array. Only its other words are rows of their own, shuffled to be looked up; words outside the vocabulary get
    the unknown id. No known word of the shuffled part can be hot; should an unknown one be, adaptive
    execution splits it, since nothing is aggregated by word here.
    """
    limit = FIRST_WORD_ID + head_words
    head = vocab.filter(F.col("token_id") < limit).select("word", F.col("token_id").cast("int")).toArrow()
    index = dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist()))
    shipped = lines.sparkSession.sparkContext.broadcast(index)
    tail = vocab.filter(F.col("token_id") >= limit).select(F.col("word").alias("tail_word"), F.col("token_id").alias("tail_id"))

    @F.arrow_udf(ArrayType(IntegerType()))
    def known(texts: pa.Array) -> pa.Array:
        ids = shipped.value
        return pa.array([[ids.get(w, OPEN) for w in (t or "").split()] for t in texts.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf(_OPEN_WORDS)
    def unknown(texts: pa.Array) -> pa.Array:
        ids, places, open_words, ends = shipped.value, [], [], [0]
        for t in texts.to_pylist():
            line = (t or "").split()
            at = [i for i, w in enumerate(line) if w not in ids]
            places += at
            open_words += [line[i] for i in at]
            ends.append(len(places))
        columns = [pa.array(places, pa.int32()), pa.array(open_words, pa.string())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["token_at", "word"]))

    found = lines.select(*keys, known(F.col(text)).alias("found"), F.lit(None).cast(_PLACED).alias("placed"))
    others = (
        lines.select(*keys, F.explode(unknown(F.col(text))).alias("at"))
        .select(*keys, "at.*")
        .join(tail, F.col("word") == F.col("tail_word"), "left")
        .select(*keys, F.struct("token_at", F.coalesce("tail_id", F.lit(UNKNOWN_ID)).cast("int").alias("token")).alias("placed"))
        .withColumn("found", F.lit(None).cast("array<int>"))
    )
    gathered = found.unionByName(others).groupBy(*keys).agg(
        F.collect_list("found").alias("found"), F.collect_list("placed").alias("placed")
    )
    out = gathered.select(*keys, _filled("found", "placed").alias("input_ids"))
    return out.withColumn("attention_mask", attention_mask(F.col("input_ids"))) if with_mask else out


def make_batches(
    rows: DataFrame, key: str, batch_size: int, seed: int | None = 42
) -> DataFrame:
    """Add ``batch_id``: consecutive batches in shuffled order, or in key order.

    Only the last batch can be short. For key order (``seed=None``) the rows are written once, as they
    come, and only their keys are put in ranges, numbered and joined back: Spark picks ranges
    of equal size whatever the keys look like, and once written a recomputed task cannot see other
    ranges. Equal keys come in any order, null ones first.
    """
    batch = F.floor((F.col("_row_at") - 1) / batch_size).cast("bigint").alias("batch_id")
    if seed is not None:
        return shuffled_position(rows, key, seed, "_row_at").select(*rows.columns, batch)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    keys = rows.select(key, "_row").repartitionByRange(key, "_row").withColumn("_range", F.spark_partition_id())
    numbered = position(stored(keys, "keys"), [], [F.col(key), F.col("_row")], [F.col("_range")], "_row_at")
    return rows.join(numbered.select("_row", batch), "_row").drop("_row")


def pad_batch(
    rows: DataFrame,
    pad_id: int = PAD_ID,
    max_length: int | None = MAX_BATCH_LENGTH,
    batch: str = "batch_id",
) -> DataFrame:
    """Ids, mask and labels of equal length within each batch.

    The length is that of the longest row, capped by ``max_length``. A batch is
    one window partition, so its size has to be bounded, as ``make_batches`` does.
    """
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    width = longest if max_length is None else F.least(longest, F.lit(max_length))
    size = F.col("_width")
    return rows.withColumn("_width", width).withColumns(
        {
            "input_ids": padded(F.col("input_ids"), size, pad_id),
            "attention_mask": padded(F.col("attention_mask"), size, 0),
            "labels": padded(F.col("input_ids"), size, IGNORED_LABEL),
        }
    ).drop("_width")
