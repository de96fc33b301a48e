"""Sinks for items, lines, datasets, chunk collections and metric records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.operators.chunks import chunk_documents, number_chunks
from docloom.plans.bloom import MOST_KEYS, bloom_filter, may_hold
from docloom.plans.segments import carry_in
from docloom.plans.stored import stored
from docloom.session import folder_exists, work_scope
from docloom.sources.documents import PACKED

#: Positions of a document that one line of packed items holds.
SEGMENT_ITEMS = 10_000

# Decimals of the report columns.
REPORT_DECIMALS = {
    "latency": 4,
    "total_cost": 6,
    "throughput": 2,
    "flesch_reading_ease": 2,
    "accuracy": 4,
    "consistency": 4,
}

# Columns of the report in order, and their headers.
REPORT_HEADERS = {
    "run": "Run",
    "answer": "Answer",
    "latency": "Latency (s)",
    "prompt_tokens": "Prompt Tokens",
    "completion_tokens": "Completion Tokens",
    "total_tokens": "Total Tokens",
    "total_cost": "Total Cost ($)",
    "throughput": "Throughput (tokens/s)",
    "word_count": "Word Count",
    "char_count": "Character Count",
    "sentence_count": "Sentence Count",
    "flesch_reading_ease": "Flesch Reading Ease",
    "accuracy": "Accuracy",
    "consistency": "Consistency",
}


def item_key(relative_path: Column) -> Column:
    """Output name of a document: ``.pdf.json`` becomes ``.json``."""
    name = F.element_at(F.split(relative_path, "/"), -1)
    folder = F.substring(relative_path, F.lit(1), F.length(relative_path) - F.length(name))
    renamed = F.when(
        name.endswith(".pdf.json"), F.replace(name, F.lit(".pdf.json"), F.lit(".json"))
    ).otherwise(name)
    return F.concat(folder, renamed)


def _item_json() -> Column:
    """An item as JSON: ``value`` is a string in texts and headers and a boolean in checkboxes.

    A null value stays an explicit null, and kinds without value or question have no such key.
    """
    keep = {"ignoreNullFields": "false"}
    kind = F.col("type")
    text = F.to_json(F.struct("type", F.col("value_text").alias("value"), "section", "page_number"), keep)
    box = F.to_json(F.struct("type", "question", F.col("value_bool").alias("value"), "section", "page_number"), keep)
    bare = F.to_json(F.struct("type", "section", "page_number"), keep)
    return F.when(kind == "checkbox", box).when(kind == "image", bare).otherwise(text)


def item_documents(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, n_items, content): one JSON array per group, its items in order of ``idx``.

    A row with null ``idx`` stands for a document without items, an empty array.
    """
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", _item_json().alias("json")))
    docs = items.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    content = F.concat(F.lit("["), F.array_join("lines.json", ","), F.lit("]"))
    return docs.select(*by, F.size("lines").cast("bigint").alias("n_items"), content.alias("content"))


def write_items(
    items: DataFrame, folder: str, application: str = "application", document: str = "document", segment_items: int = SEGMENT_ITEMS
) -> None:
    """All documents' items, packed into few files of even size, with an index.

    A line of a file below ``items`` is one document, or one of the ordered segments of a document with
    more than ``segment_items`` positions, so no task gathers a long document. ``index`` says for each line
    where it stands: application, document, segment, n_items, file, offset and length in bytes.
    ``read_item_docs`` reads the folder back.
    """
    segment = F.floor(F.coalesce("idx", F.lit(0)) / segment_items).cast("bigint")
    named = items.withColumns({"application": F.col(application).cast("string"), "document": F.col(document).cast("string"), "segment": segment})
    lines = item_documents(named, ["application", "document", "segment"])
    head = F.to_json(F.struct("application", "document", "segment", "n_items"), {"ignoreNullFields": "false"})
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"items":'), "content", F.lit("}"))
    lines.select(line.alias("value")).hint("rebalance").write.mode("overwrite").text(f"{folder}/items")
    _line_places(items.sparkSession, f"{folder}/items").write.mode("overwrite").parquet(f"{folder}/index")


def _line_places(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the lines of all files below ``folder``; a file is read by as many tasks as its ranges."""
    told = F.from_json(F.col("value"), "application string, document string, segment bigint, n_items bigint")
    rows = spark.read.text(folder, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.octet_length("value").cast("bigint").alias("length"),
        told.alias("told"),
    )
    rows = carry_in(rows.select("file", "block", "row", "length", "told.*"), ["file"], "block", {"earlier": ("sum", F.sum(F.col("length") + 1))})
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("earlier") + F.coalesce(F.sum(F.col("length") + 1).over(inside), F.lit(0))
    return rows.select("application", "document", "segment", "n_items", "file", offset.alias("offset"), "length")


def write_item_files(items: DataFrame, folder: str, application: str = "application", document: str = "document") -> None:
    """Every document's items as one array in a file of its own, below its application's folder.

    For consumers that want a file per document; a folder and a task's memory per document are its price.
    """
    docs = item_documents(items, [application, document]).drop("n_items")
    docs.hint("rebalance", application).write.mode("overwrite").partitionBy(application, document).text(folder)


def write_packed_docs(docs: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """Documents packed into few files, each with its path below ``folder``; the document sources read them as files.

    A file and a folder per document cost the file system some calls each, which is most of the time with many small ones.
    """
    docs.select(F.col(path).alias("path"), F.col(content).alias("content")).write.mode("overwrite").parquet(f"{folder}/{PACKED}")


def write_jsonl(df: DataFrame, folder: str) -> None:
    """One JSON object per line, characters and nulls kept as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def append_metrics_csv(records: DataFrame, folder: str) -> None:
    """Append metric records; every part file starts with the header."""
    records.write.mode("append").option("header", True).option("escape", '"').csv(folder)


def _fixed(places: int):
    """Python's fixed notation: rounds the exact binary value, which Java's does not."""

    @F.pandas_udf(StringType())
    def fixed(value: pd.Series) -> pd.Series:
        return value.map(lambda v: f"{v:.{places}f}", na_action="ignore")

    return fixed


def report_columns(records: DataFrame, decimals: Mapping[str, int] = REPORT_DECIMALS) -> DataFrame:
    """Fixed-decimal text for the rounded columns; a null stays empty."""
    return records.withColumns(
        {
            name: _fixed(places)(F.col(name).cast("double"))
            for name, places in decimals.items()
            if name in records.columns
        }
    )


def write_report_csv(records: DataFrame, folder: str) -> None:
    """The report's columns in their fixed order under their fixed headers; other columns come first."""
    known = [c for c in REPORT_HEADERS if c in records.columns]
    others = [c for c in records.columns if c not in REPORT_HEADERS]
    report = report_columns(records).select(*others, *[F.col(c).alias(REPORT_HEADERS[c]) for c in known])
    report.write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(folder)


def save_dataset(dataset: DataFrame, path: str) -> None:
    dataset.write.mode("overwrite").parquet(path)


def new_chunks(chunks: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Chunks whose id the collection does not hold yet, one row per id.

    Of several new rows with one id the smallest stays, whatever order they come in. The collection's ids
    are tested against a Bloom filter of the new ones as they are read, so only ids that may be among them
    are shuffled; beyond ``bloom.MOST_KEYS`` new ids all are.
    """
    others = [c for c in chunks.columns if c != "chunk_id"]
    fresh = chunks.groupBy("chunk_id").agg(F.min(F.struct(*others)).alias("row")).select("chunk_id", "row.*")
    if existing is None:
        return fresh
    fresh, known = stored(fresh, "fresh"), existing.select("chunk_id")
    n = fresh.count()
    if n <= MOST_KEYS:
        known = may_hold(known, "chunk_id", stored(bloom_filter(fresh, "chunk_id", n), "filter"), n)
    return fresh.join(known, "chunk_id", "left_anti")


def populate_chunks(docs: DataFrame, path: str) -> None:
    """Markdown documents (path, application, filename, text) as numbered chunks in the collection at ``path``.

    Chunks carry their document's application and file name; ids already there stay.
    """
    cut = stored(chunk_documents(docs, "path", keep=["application", "filename"]), "chunks")
    upsert_chunks(number_chunks(cut, "path"), path)


def upsert_chunks(chunks: DataFrame, path: str, application: str = "application") -> None:
    """Add chunks to the collection at ``path``; ids already there stay untouched.

    The collection is partitioned by application so that a filtered search reads
    only its own folder.
    """
    spark = chunks.sparkSession
    with work_scope(spark, "upsert"):
        existing = spark.read.parquet(path) if folder_exists(spark, path) else None
        new_chunks(chunks, existing).hint("rebalance", application).write.mode("append").partitionBy(
            application
        ).parquet(path)
