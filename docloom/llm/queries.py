"""One query per operator over the driver tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    ann,
    brown,
    decontaminate,
    licenses,
    packing,
    pieces,
    pii,
    ranking,
    runs,
    simhash,
    substring,
    toxicity,
    urlfilter,
)
from docloom.llm.columns import few_texts_at_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    few_texts_at_once(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_compact_windows": lambda s, d: substring.digest(table(s, d, "documents")),
    "op2_bloom_cascade": lambda s, d: urlfilter.digest(table(s, d, "pages")),
    "op3_best_fit_packing": lambda s, d: packing.digest(table(s, d, "documents")),
    "op4_decontamination": lambda s, d: decontaminate.digest(table(s, d, "documents"), table(s, d, "benchmark")),
    "op5_pii_bootstrap": lambda s, d: pii.digest(table(s, d, "documents")),
    "op6_projection_forest": lambda s, d: ann.digest(table(s, d, "embeddings")),
    "op7_ordinal_toxicity": lambda s, d: toxicity.digest(table(s, d, "documents"), table(s, d, "labels")),
    "op8_simhash_anchors": lambda s, d: simhash.digest(table(s, d, "documents")),
    "op9_brown_classes": lambda s, d: brown.digest(table(s, d, "documents")),
    "op10_license_index": lambda s, d: licenses.digest(table(s, d, "documents")),
    "op11_prefix_table": lambda s, d: pieces.digest(table(s, d, "documents")),
    "op12_shared_ranking": lambda s, d: ranking.digest(table(s, d, "documents"), table(s, d, "benchmark")),
    "op13_block_convolution": lambda s, d: runs.digest(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_bloom_cascade": urlfilter.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op12_shared_ranking": ranking.ORACLE,
    "op13_block_convolution": runs.ORACLE,
}
