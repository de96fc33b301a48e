"""Session defaults and the shared work folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def build_session(app: str = "docloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use.

    On a cluster the session comes from ``spark-submit``; nothing in the
    library depends on this function.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The folder of the innermost ``work_scope``.
_SCOPE: ContextVar[str | None] = ContextVar("docloom_work_scope", default=None)


def _work_root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/docloom-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path of this application in the shared folder ``spark.checkpoint.dir``.

    Only a local session may leave that unset; its folder is ``spark.sql.warehouse.dir``.
    ``drop_work`` removes all of the application's, ``work_scope`` what is stored inside it.
    """
    return f"{_SCOPE.get() or _work_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def work_scope(spark: SparkSession, label: str) -> Iterator[None]:
    """What is stored inside is deleted at the end, so results have to be written by then."""
    folder = work_folder(spark, label)
    outer = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        drop_folder(spark, folder)


def drop_work(spark: SparkSession) -> None:
    """Delete everything this application stored; call it once its results are written."""
    drop_folder(spark, _work_root(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark reaches; none there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
