"""Token lines, ordered text lines, gold answers and saved datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.text import strip
from docloom.sources.documents import whole_files


def read_token_jsonl(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Token rows of every line file; blank lines give no row.

    A line that is no token row is kept in ``corrupt_record``.
    """
    return (
        spark.read.schema(schemas.TOKEN_LINE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("columnNameOfCorruptRecord", "corrupt_record")
        .json(folder)
        .select("*", F.col("_metadata.file_path").alias("doc_path"))
    )


def read_ordered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, 1-based ordinal, line); the line number is the key of the line.

    The file is read whole because line order is only certain inside one row. A
    newline at the end of the file does not open another line.
    """
    at_line = F.posexplode(F.split(F.regexp_replace("content", r"\r?\n\z", ""), r"\r?\n")).alias("at", "line")
    return whole_files(spark, path, glob).select(F.col("doc_path").alias("file"), at_line).select(
        "file", (F.col("at") + 1).cast("bigint").alias("ordinal"), "line"
    )


def read_gold_answers(spark: SparkSession, path: str) -> DataFrame:
    """(application_id, question_id, answer, ordinal, corrupt_record) from nested gold answers.

    Question keys may be ``"1"`` or ``"Question 1"``. ``ordinal`` is the place among all
    entries, files in the order of their paths, for the rule that the last entry of an
    application wins. A file that cannot be read is one row with ``corrupt_record`` set.
    """
    # files hold this many entries at most, so a file's number sets the high part of the ordinal
    files_of = 2**32
    entries = (
        spark.read.schema(schemas.GOLD_FILE)
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "corrupt_record")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    # one row per file meets in this window
    number = F.row_number().over(Window.orderBy("file")) - 1
    numbered = entries.select("file").distinct().select("file", number.alias("number"))
    entries = entries.join(numbered, "file").select(
        "corrupt_record", "number", F.posexplode_outer("application_summaries").alias("at", "entry")
    )
    return entries.filter(F.col("entry").isNotNull() | F.col("corrupt_record").isNotNull()).select(
        strip(F.col("entry.folder_id")).alias("application_id"),
        (F.col("number") * files_of + F.coalesce("at", F.lit(0))).cast("bigint").alias("ordinal"),
        "corrupt_record",
        F.explode_outer("entry.questions").alias("key", "answer"),
    ).select(
        "application_id",
        F.regexp_extract("key", r"([0-9]+)$", 1).cast("bigint").alias("question_id"),
        "answer",
        "ordinal",
        "corrupt_record",
    ).filter(F.col("question_id").isNotNull() | F.col("corrupt_record").isNotNull())


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
