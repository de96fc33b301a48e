"""Column functions over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def arrow_function(result: pa.DataType) -> Callable:
    """``F.arrow_udf`` for a result type given as Arrow's; needs no session yet."""
    return F.arrow_udf(from_arrow_type(result))


def few_texts_at_once(spark: SparkSession, rows: int = 2_000) -> None:
    """Smaller Arrow batches for tables of whole texts, unless the session chose its own size."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))
