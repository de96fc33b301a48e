"""Training log queries: a user is a run, its events are evaluations in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import trainlog as L
from docloom.plans.segments import position
from docloom.plans.stored import stored
from docloom.registry import sql
from docloom.registry.tables import table


def log(spark, d) -> DataFrame:
    day = F.floor(F.unix_micros("ts") / L.DAY_US)
    events = table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("loss")
    )
    numbered = position(events, ["run"], [F.col("ts"), F.col("event_id")], [day], "eval")
    return stored(numbered.withColumn("step", F.floor(F.col("eval") * 2 / 3).cast("bigint")), "log")


def tokens_per_second(spark, d):
    return L.tokens_per_second(log(spark, d)).select(
        "run", "step", F.round("tokens_per_second", 6).alias("tokens_per_second")
    )


def total_tokens_seen(spark, d):
    return log(spark, d).select(
        "run", "eval", L.total_tokens_seen(F.col("step"), L.tokens_per_step()).alias("total_tokens_seen")
    )


def early_stop_step(spark, d):
    return L.early_stop_step(log(spark, d).select("run", F.col("eval").alias("step"), "loss"), segment_steps=32)


QUERIES = {
    "tokens_per_second": tokens_per_second,
    "total_tokens_seen": total_tokens_seen,
    "early_stop_step": early_stop_step,
}

SPEED = f"""WITH {sql.TRAIN_LOG},
      marked AS (SELECT *, max(step) OVER (PARTITION BY run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
        FROM steps),
      kept AS (SELECT * FROM marked WHERE best IS NULL OR step > best),
      timed AS (SELECT *, lag(ts) OVER (PARTITION BY run ORDER BY ts) AS last_ts,
        lag(step) OVER (PARTITION BY run ORDER BY ts) AS last_step FROM kept)
      SELECT run, step, round((step - last_step) * 16384 / ((epoch_us(ts) - epoch_us(last_ts)) / 1e6), 6) AS tokens_per_second
      FROM timed WHERE last_ts IS NOT NULL"""

ORACLES = {
    "tokens_per_second": SPEED,
    "total_tokens_seen": f"WITH {sql.TRAIN_LOG} SELECT run, eval, step * 16384 AS total_tokens_seen FROM steps",
    "early_stop_step": f"""WITH {sql.TRAIN_LOG},
      improving AS (SELECT run, eval, loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY eval
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS better FROM log),
      streaks AS (SELECT run, eval, sum(better::INT) OVER (PARTITION BY run ORDER BY eval) AS island, better FROM improving),
      counted AS (SELECT run, eval, sum((NOT better)::INT) OVER (PARTITION BY run, island ORDER BY eval) AS streak FROM streaks)
      SELECT run, min(eval) AS stop_step FROM counted WHERE streak >= 3 GROUP BY run""",
}
