"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet below the session's shared folder and reads it again as the next stage's docs.
All stages but the last return the columns of ``documents``. A stage works on every row
its predecessor kept; what each does with nulls, empty texts, repeated rows and empty
tables stands in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, packing, pii, simhash, toxicity
from docloom.llm.columns import few_texts_at_once
from docloom.llm.queries import table
from docloom.session import drop_folder, work_folder, work_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not grade as toxic.

    The model is fitted on labelled rows of the documents given.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies: the one with the smallest id."""
    few_texts_at_once(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words in benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    few_texts_at_once(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences of 1024 tokens."""
    few_texts_at_once(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Tokenising, fitting and hashing whole texts has no SQL form; tests/llm holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage stores on its way goes when it is written, its input when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_folder(spark, name)
        with work_scope(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
