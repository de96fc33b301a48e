"""Rates and early stopping from training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.segments import carry_in

# Sequence length, batch size, accumulation steps and patience.
SEQ_LEN, BATCH_SIZE, GRAD_ACCUM = 1024, 1, 16
PATIENCE = 3

DAY_US = 86_400_000_000


def tokens_per_step(seq_len: int = SEQ_LEN, batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM) -> int:
    return seq_len * batch_size * grad_accum


def total_tokens_seen(step: Column, per_step: int) -> Column:
    return step * F.lit(per_step).cast("bigint")


def tokens_per_second(
    log: DataFrame, per_step: int = tokens_per_step(), segment_us: int = DAY_US
) -> DataFrame:
    """(run, step, ts, tokens_per_second, total_tokens_seen) per logged step.

    ``log`` has run, step and ts; the first row of a run is its begin and gives no
    rate. A row whose step does not pass the highest one so far is skipped and
    does not move the clock: so the reference row is the earliest one with the
    highest step. A run is cut into time segments, and each receives that row
    from the segments before it.
    """
    at = F.unix_micros("ts")
    mark = F.struct(F.col("step").alias("step"), (-at).alias("neg_us"))
    df = log.select("run", "step", "ts", F.floor(at / segment_us).cast("bigint").alias("segment"))
    df = carry_in(df, ["run"], "segment", {"mark_in": ("max", F.max(mark))})
    earlier = (
        Window.partitionBy("run", "segment").orderBy("ts", "step").rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("mark", F.greatest(F.max(mark).over(earlier), F.col("mark_in")))
    seconds = (at + F.col("mark.neg_us")) / F.lit(1e6)
    done = (F.col("step") - F.col("mark.step")) * F.lit(per_step)
    return df.filter(F.col("step") > F.col("mark.step")).select(
        "run",
        "step",
        "ts",
        F.when(seconds > 0, done / seconds).alias("tokens_per_second"),
        total_tokens_seen(F.col("step"), per_step).alias("total_tokens_seen"),
    )


def early_stop_step(log: DataFrame, patience: int = PATIENCE, segment_steps: int = 1_000_000) -> DataFrame:
    """(run, stop_step): first step with ``patience`` evaluations in a row that did not improve.

    ``log`` has run, step and loss, one row per evaluation. A run that never
    stops has no row. Per segment the lowest loss, where it first occurs and the
    number of rows are enough to know what later segments start from.
    """
    df = log.select("run", "step", "loss", F.floor(F.col("step") / segment_steps).cast("bigint").alias("segment"))
    inside = Window.partitionBy("run", "segment").orderBy("step")
    local = df.withColumn("row", F.row_number().over(inside))
    earlier = Window.partitionBy("run").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        local.groupBy("run", "segment")
        .agg(F.min(F.struct("loss", "row")).alias("low"), F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "best_in": F.min("low.loss").over(earlier),
                "rows_in": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            }
        )
    )
    improved = F.col("best_in").isNull() | (F.col("low.loss") < F.col("best_in"))
    summary = summary.withColumn("best_at", F.when(improved, F.col("rows_in") + F.col("low.row"))).select(
        F.col("run").alias("in_run"),
        F.col("segment").alias("in_segment"),
        "best_in",
        "rows_in",
        F.max("best_at").over(earlier).alias("best_at_in"),
    )
    df = local.join(summary, (F.col("run") == F.col("in_run")) & (F.col("segment") == F.col("in_segment")))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.least(F.min("loss").over(before), F.col("best_in"))
    df = df.withColumns({"at": F.col("rows_in") + F.col("row"), "best": best})
    improves = F.col("best").isNull() | (F.col("loss") < F.col("best"))
    best_at = F.greatest(F.max(F.when(improves, F.col("at"))).over(so_far), F.col("best_at_in"))
    return (
        df.withColumn("streak", F.col("at") - best_at)
        .filter(F.col("streak") >= patience)
        .groupBy("run")
        .agg(F.min("step").alias("stop_step"))
    )
