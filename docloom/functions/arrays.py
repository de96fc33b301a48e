"""Token array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token datasets.
MAX_DATASET_LENGTH = 2048
MAX_BATCH_LENGTH = 1024
IGNORED_LABEL = -100


def truncate_ids(ids: Column, length: int = MAX_DATASET_LENGTH) -> Column:
    return F.slice(ids, 1, length)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("tinyint"), F.size(ids))


def padded(values: Column, width: Column, filler: int) -> Column:
    """``values`` as bigint, cut or filled up to ``width``."""
    cut = F.slice(values, F.lit(1), width).cast("array<bigint>")
    return F.concat(cut, F.array_repeat(F.lit(filler).cast("bigint"), (width - F.size(cut)).cast("int")))
