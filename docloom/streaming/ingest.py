"""New document files to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.extract import extract_sound
from docloom.session import folder_exists, work_scope
from docloom.sources.documents import PACKED, PACKED_COLUMNS, is_packed, packed_files, parse_elements


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    """(doc_path, epoch) of every file taken in below ``out``, or None before the first."""
    manifest = f"{out}/manifest"
    return spark.read.parquet(manifest) if folder_exists(spark, manifest) else None


def stream_ingest_docs(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    glob: str = "*.json",
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Items of every document file that appears below ``folder``.

    A file is a whole document, so no state crosses micro-batches and each one
    runs the batch extraction. A folder that ``write_packed_docs`` wrote is taken in by its files of many documents. Below ``out`` each micro-batch leaves its ``items``
    and ``rejected`` documents, then its files in the ``manifest``, which makes it finished. Files in
    the manifest are not taken in again, whether a finished micro-batch is repeated or the
    checkpoint was lost; one that was not finished is written over by its repetition. What
    a micro-batch stored on its way is deleted at its end.
    """
    packed = is_packed(spark, folder)
    if packed:
        rows = spark.readStream.schema(PACKED_COLUMNS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{PACKED}")
        files = packed_files(rows, folder, glob)
    else:
        files = (
            spark.readStream.option("wholetext", "true")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch)
            .format("text")
            .load(folder)
            .select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("content"))
        )

    def each(batch: DataFrame, _: int) -> None:
        done = finished(spark, out)
        epoch = 0
        if done is not None:
            epoch = (done.agg(F.max("epoch")).first()[0] or 0) + 1
            # a micro-batch has ``files_per_batch`` paths at most, unless its files hold many
            paths = batch.select("doc_path")
            known = done.join(paths if packed else F.broadcast(paths), "doc_path", "left_semi").select("doc_path")
            batch = batch.join(known, "doc_path", "left_anti")
        if batch.isEmpty():
            return
        with work_scope(spark, "epoch"):
            items, rejected = extract_sound(parse_elements(batch))
            rejected.write.mode("overwrite").parquet(f"{out}/rejected/epoch={epoch}")
            items.filter("idx IS NOT NULL").write.mode("overwrite").parquet(f"{out}/items/epoch={epoch}")
        taken = batch.select("doc_path") if packed else batch.select("doc_path").coalesce(1)
        taken.write.mode("overwrite").parquet(f"{out}/manifest/epoch={epoch}")

    return (
        files.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
