"""Evaluation requests and their prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.prompts import build_prompt

# Fixed value: times every request is repeated.
N_RUNS = 3
SHARD_ROWS = 100_000


def request_grid(applications: DataFrame, questions: DataFrame, runs: int = N_RUNS) -> DataFrame:
    """(run, application_id, question_id, question): every question about every application.

    Applications are dealt over shards by hash and the questions (ordinal, line)
    repeated for every shard, so neither list is bounded nor passes the driver.
    """
    shards = max(1, -(-applications.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("application_id"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = questions.select(F.col("ordinal").alias("question_id"), F.col("line").alias("question"), every.alias("shard"))
    run = F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<bigint>")).alias("run")
    return (
        applications.select("application_id", shard.alias("shard"))
        .join(asked, "shard")
        .select(run, "application_id", "question_id", "question")
    )


def zip_by_ordinal(questions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Question line n with prompt line n."""
    return questions.select("ordinal", F.col("line").alias("question")).join(
        prompts.select("ordinal", F.col("line").alias("template")), "ordinal"
    )


def attach_outputs(requests: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Model outputs (answers, vectors, counts) joined to their requests by id.

    A request without output keeps nulls. Two outputs for one id fail the job, as
    either could be meant.
    """
    values = [c for c in outputs.columns if c not in on]
    one = outputs.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*values)).alias("_out"))
    twice = F.concat(F.lit("more than one output for "), F.to_json(F.struct(*on)))
    out = F.when(F.col("_n") == 1, F.col("_out")).otherwise(F.raise_error(twice))
    return requests.join(one.select(*on, out.alias("_out")), list(on), "left").select("*", "_out.*").drop("_out")


def prepare_prompts(requests: DataFrame) -> DataFrame:
    """Add the prompt and the two lengths that are recorded with it.

    ``requests`` has template, context and question.
    """
    prompt = build_prompt(F.col("template"), F.col("context"), F.col("question"))
    return requests.withColumn("full_promt", prompt).withColumns(
        {
            "context_len_c": F.length("context").cast("bigint"),
            "full_promt_len_c": F.length("full_promt").cast("bigint"),
        }
    )
