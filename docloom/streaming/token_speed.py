"""Training speed over a growing log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.trainlog import DAY_US, tokens_per_second, tokens_per_step
from docloom.session import drop_folder, folder_exists

#: So many micro-batches' changes are merged into one table.
MERGED = 10


def _highest(points: DataFrame) -> DataFrame:
    """(run, step, ts): the highest step of every run and the time it was first seen."""
    best = F.max(F.struct(F.col("step"), (-F.unix_micros("ts")).alias("neg_us"))).alias("best")
    return points.groupBy("run").agg(best).select(
        "run", F.col("best.step").alias("step"), F.timestamp_micros(-F.col("best.neg_us")).alias("ts")
    )


def _read(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    tables = [spark.read.parquet(f) for f in folders if folder_exists(spark, f"{f}/_SUCCESS")]
    return reduce(DataFrame.unionByName, tables) if tables else None


def remembered(spark: SparkSession, state: str, epoch: int) -> DataFrame | None:
    """What the micro-batches before ``epoch`` left behind, a row or more per run; None before the first.

    That is the last merged table and the changes since. It is merged here when it is due; a
    micro-batch run again finds the merged table complete, or merges the same rows again.
    """
    due = epoch - epoch % MERGED
    merged = f"{state}/merged={due}"
    if due and epoch == due and not folder_exists(spark, f"{merged}/_SUCCESS"):
        before = [f"{state}/merged={due - MERGED}", *(f"{state}/epoch={e}" for e in range(due - MERGED, due))]
        old = _read(spark, before)
        if old is not None:
            _highest(old).write.mode("overwrite").parquet(merged)
    return _read(spark, [merged, *(f"{state}/epoch={e}" for e in range(due, epoch))])


def forget(spark: SparkSession, state: str, epoch: int) -> None:
    """Delete what went into a merged table, once the micro-batch that made it is surely over."""
    due = epoch - epoch % MERGED
    if epoch == due + 1 and due:
        for folder in (f"{state}/merged={due - MERGED}", *(f"{state}/epoch={e}" for e in range(due - MERGED, due))):
            drop_folder(spark, folder)


def stream_token_speed(
    log: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    per_step: int = tokens_per_step(),
    segment_us: int = DAY_US,
) -> StreamingQuery:
    """Rates of every micro-batch of ``log`` (run, step, ts), appended below ``out``.

    What has to be remembered is one row per run: the highest step and the time
    it was first seen. Below ``state`` a micro-batch writes the rows of its own runs only, and reads only theirs;
    every ``MERGED`` micro-batches the changes are merged into one table. A micro-batch that is run
    again reads and writes the same places. It goes through the batch operator with the remembered
    rows in front, which keeps a run with most of the rows in many tasks.
    """
    spark = log.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        points = batch.select("run", "step", "ts")
        old = remembered(spark, state, epoch)
        if old is not None:
            mine = old.join(points.select("run").distinct(), "run", "left_semi")
            points = _highest(mine).unionByName(points)
        tokens_per_second(points, per_step, segment_us).write.mode("overwrite").parquet(
            f"{out}/epoch={epoch}"
        )
        _highest(points).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        forget(spark, state, epoch)

    return (
        log.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
