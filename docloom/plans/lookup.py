"""Left join of a large side to a unique-key side when some keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def lookup(
    rows: DataFrame, facts: DataFrame, on: Sequence[str], spread_by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """``rows`` left join ``facts``, every hot key split over ``salts`` tasks.

    ``facts`` has one row per key and is repeated once per salt; a row takes its
    salt from ``spread_by``, columns that differ between rows of one key. The salt
    is a function of the data, so a recomputed task sends its rows the same way.
    Where ``facts`` is small enough Spark broadcasts it and nothing is shuffled.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], "left").drop("_salt")
