"""Corpus audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_audit(
    manifest: DataFrame, docs: DataFrame, items: DataFrame, doc: str = "doc_path"
) -> DataFrame:
    """(measure, name, n): what the corpus should hold and what it does.

    Measures: expected, present, missing (in the manifest only), unlisted, empty
    (no items), the column sets documents come with, and items by type. Column sets
    are the ``keys`` found in the files; items made here have none and get those they
    would be written with.
    """
    expected = manifest.select(doc).distinct().withColumn("expected", F.lit(1))
    present = docs.select(doc).distinct().withColumn("present", F.lit(1))
    observed = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))), ",").alias("columns")] if "keys" in items.columns else []
    shape = items.groupBy(doc).agg(
        *observed,
        F.bool_or(F.col("type").isin("text", "header")).alias("texts"),
        F.bool_or(F.col("type") == "checkbox").alias("boxes"),
    )
    columns = F.array_join(
        F.array_compact(
            F.array(
                F.lit("page_number"),
                F.when(F.col("boxes"), "question"),
                F.lit("section"),
                F.lit("type"),
                F.when(F.col("texts") | F.col("boxes"), "value"),
            )
        ),
        ",",
    )
    both = expected.join(present, doc, "full").join(shape if observed else shape.withColumn("columns", columns), doc, "left")
    here, listed = F.col("present").isNotNull(), F.col("expected").isNotNull()
    facts = F.array(
        F.when(listed, F.lit("expected")),
        F.when(here, F.lit("present")),
        F.when(listed & ~here, F.lit("missing")),
        F.when(here & ~listed, F.lit("unlisted")),
        F.when(here & F.col("columns").isNull(), F.lit("empty")),
        F.when(here & F.col("columns").isNotNull(), F.lit("columns")),
    )
    per_doc = (
        both.select("columns", F.explode(F.array_compact(facts)).alias("measure"))
        .withColumn("name", F.when(F.col("measure") == "columns", F.col("columns")).otherwise(""))
        .groupBy("measure", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_type = items.groupBy(F.lit("items").alias("measure"), F.col("type").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_doc.unionByName(per_type)
