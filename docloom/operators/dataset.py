"""Held-out groups, splits and the training dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrays import MAX_DATASET_LENGTH, attention_mask, truncate_ids
from docloom.plans.segments import seeded_digest

# Groups kept for evaluation, split seed and share.
HELD_OUT_GROUPS = 15
SPLIT_SEED = 42
TEST_RATIO = 0.01


def last_groups(rows: DataFrame, group: str, n: int = HELD_OUT_GROUPS) -> DataFrame:
    """The ``n`` groups that sort last; at most ``n`` rows."""
    return rows.select(group).distinct().orderBy(F.col(group).desc()).limit(n)


def holdout_groups(
    rows: DataFrame, group: str, n: int = HELD_OUT_GROUPS
) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows): the last ``n`` groups are for evaluation.

    With ``n`` groups or fewer nothing is left for training. The broadcast holds
    at most ``n`` rows.
    """
    held = F.broadcast(last_groups(rows, group, n))
    return rows.join(held, group, "left_anti"), rows.join(held, group, "left_semi")


def train_test_split(
    rows: DataFrame, key: str, ratio: float = TEST_RATIO, seed: int = SPLIT_SEED, digits: int = 4
) -> DataFrame:
    """Add ``is_test``: exactly ceil(rows * ratio) rows chosen by seeded md5 order.

    Rows are counted per digest prefix; a table of at most ``16 ** digits`` rows
    says which prefixes are test as a whole and, for the one prefix the border
    runs through, the digest it stops at. The rows themselves are neither
    shuffled nor sorted. ``key`` has to be unique; rows with a null key are training
    rows, and the ratio is that of the others.
    """
    if ratio == 0:
        return rows.withColumn("is_test", F.lit(False))
    digest = seeded_digest(F.col(key), seed)
    prefix = F.substring("_digest", 1, digits)
    digests = rows.select(digest.alias("_digest")).dropna().withColumn("_prefix", prefix)
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(F.sum("_size").over(everything) * F.lit(ratio))
    prefixes = (
        digests.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_prefix", "_size", (wanted - F.coalesce(F.sum("_size").over(earlier), F.lit(0))).alias("_take"))
    )
    border = prefixes.filter((F.col("_take") > 0) & (F.col("_take") < F.col("_size")))
    stop = (
        digests.join(F.broadcast(border), "_prefix")
        .withColumn("at", F.row_number().over(Window.partitionBy("_prefix").orderBy("_digest")))
        .filter(F.col("at") == F.col("_take"))
        .select("_prefix", F.col("_digest").alias("_stop"))
    )
    rule = prefixes.join(stop, "_prefix", "left")
    taken = F.when(F.col("_stop").isNotNull(), F.col("_digest") <= F.col("_stop")).otherwise(F.col("_take") > 0)
    return (
        rows.withColumn("_digest", digest)
        .withColumn("_prefix", prefix)
        .join(F.broadcast(rule), "_prefix", "left")
        .withColumn("is_test", F.coalesce(taken, F.lit(False)))
        .drop("_digest", "_prefix", "_size", "_take", "_stop")
    )


def make_dataset(
    tokens: DataFrame,
    group: str,
    max_length: int = MAX_DATASET_LENGTH,
    n: int = HELD_OUT_GROUPS,
    skip_malformed: bool = False,
) -> DataFrame:
    """Training rows: held-out groups removed, ids cut, mask recomputed.

    Blank lines are no rows. A line that could not be read (``corrupt_record``)
    fails the job, unless ``skip_malformed`` says to leave such lines out.
    """
    sound = F.col("input_ids").isNotNull()
    if "corrupt_record" in tokens.columns and not skip_malformed:
        complaint = F.concat(F.lit("malformed token line: "), F.col("corrupt_record"))
        sound = F.when(F.col("corrupt_record").isNotNull(), F.raise_error(complaint)).otherwise(sound)
    training, _ = holdout_groups(tokens.filter(sound), group, n)
    ids = truncate_ids(F.col("input_ids"), max_length)
    return training.withColumn("input_ids", ids).withColumn(
        "attention_mask", attention_mask(F.col("input_ids"))
    )


def dataset_stats(rows: DataFrame, part: Column) -> DataFrame:
    """Rows and tokens of each part of a dataset."""
    return rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens")
    )
