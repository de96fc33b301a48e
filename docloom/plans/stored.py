"""Stage boundaries: a result written once and read from there on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docloom.session import work_folder


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared work folder.

    For results that several later steps read: they are computed once, the later
    steps read only the columns they need, and a lost executor costs a file read
    instead of the whole lineage. A ``path`` taken before a ``work_scope`` keeps the table when that ends.
    """
    path = path or work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is stored inside go as soon as it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
