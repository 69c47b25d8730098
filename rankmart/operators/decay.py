"""Recency-decayed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.functions.dates import age_days
from rankmart.functions.numeric import decay_weight, trunc_to_long


def decay_column(date_col, as_of, k: float = 0.693, half_life_days: float = 60.0,
                 missing_age: int = 365):
    """Weight of a row: age clamped at 0, missing date counted as ``missing_age`` days."""
    return decay_weight(age_days(date_col, as_of, clamp=True, missing=missing_age), k, half_life_days)


def decayed_sum(df: DataFrame, key: str, value: str, weight_col: str | None = "weight",
                count_col: str | None = None, out: str = "downloads") -> DataFrame:
    """Sum of value*weight per key, truncated to an integer after rounding to 6 digits.

    ``weight_col=None`` sums ``value`` as it is (already weighted, e.g. partial
    sums from an earlier aggregate); ``count_col`` then names the pre-counted
    rows, otherwise rows are counted. Partial sums run map-side.
    """
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    weighted = F.col(value) if weight_col is None else F.col(value) * F.col(weight_col)
    return (df.groupBy(key)
              .agg(F.sum(weighted).alias("_raw"), n.alias("model_count"))
              .withColumn(out, trunc_to_long(F.col("_raw")))
              .drop("_raw"))
