"""Band joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float) -> DataFrame:
    """Rows of both sides whose values differ by at most `tolerance`.

    The right side is put into its bucket and both neighbours, so that an equi-join finds every pair once; no
    nested loop is planned, and a hot bucket is a skewed join key that adaptive execution splits.  Null values
    join nothing.  The sides' columns must differ in name.
    """
    width = float(tolerance)
    at = F.floor(F.col(right_value) / F.lit(width)).cast("bigint")
    spread = right.filter(F.col(right_value).isNotNull()).withColumn("__band", F.explode(F.array(at - 1, at, at + 1)))
    placed = left.filter(F.col(left_value).isNotNull()).withColumn("__band", F.floor(F.col(left_value) / F.lit(width)).cast("bigint"))
    return placed.join(spread, "__band").filter(F.abs(F.col(left_value) - F.col(right_value)) <= F.lit(tolerance)).drop("__band")
