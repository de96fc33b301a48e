"""Driver tables and the shapes derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element documents made from ``documents``: every sentence whole, and after every
    second one two elements more: boxes, labels, images and empty ones.
    """
    # counted before they are exploded: beside the generator the count would read the whole text for every sentence
    parts = (
        documents(spark, sf_dir)
        .selectExpr("doc_id", "source", "split(text, '[.] ') AS sentences")
        .selectExpr("doc_id", "source", "CAST(size(sentences) AS BIGINT) AS n", "sentences")
        .selectExpr("doc_id", "source", "IF(n % 2 = 0, 2 * n, 2 * n - 1) AS n_elements", "sentences")
        .selectExpr("doc_id", "source", "n_elements", "posexplode(sentences) AS (pos, s)")
    )
    places = "IF(pos % 2 = 0, array(2 * pos), array(2 * pos - 1, 2 * pos, 2 * pos + 1))"
    return parts.selectExpr("doc_id", "source", "n_elements", "s", f"posexplode({places}) AS (nth, at)").selectExpr(
        "*", "CAST(at AS BIGINT) AS idx"
    ).selectExpr(
        "*", "nth > 0 AS inserted", "(doc_id*7919 + idx*idx*31 + idx*17 + (doc_id % 13)*idx) % 23 AS k"
    ).selectExpr(
        "doc_id",
        "source",
        "n_elements",
        "idx",
        """CASE WHEN inserted AND k=1 THEN 'Image' WHEN inserted AND k BETWEEN 7 AND 12 THEN 'FormKeysValues'
                WHEN inserted THEN 'NarrativeText' WHEN k=0 AND doc_id%10<>0 THEN 'Title' WHEN k=2 THEN 'Header'
                ELSE 'NarrativeText' END AS type""",
        """CASE WHEN inserted THEN CASE WHEN k=1 THEN NULL WHEN k IN (3,4,11) THEN 'Yes' WHEN k IN (5,6,12) THEN 'No'
                ELSE '' END WHEN k IN (13,14) THEN concat(s,'?') WHEN k=15 THEN concat(s,':') ELSE s END AS text""",
        """CASE WHEN inserted AND k IN (7,8,11) THEN '<input class="Checkbox" type="checkbox" checked/>'
                WHEN inserted AND k IN (9,10,12) THEN '<input class="Checkbox" type="checkbox"/>' ELSE '' END AS text_as_html""",
        "idx div 10 + 1 AS page_number",
    )
