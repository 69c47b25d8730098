"""Append rows of a second source whose names are absent from the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.functions.text import normalise_name


def append_missing(a: DataFrame, b: DataFrame, a_key: str, b_key: str, salted: bool = False,
                   names: DataFrame | None = None) -> DataFrame:
    """A, plus the rows of B whose case/space-normalised name is not among A's.

    A left anti join (null-safe, unlike NOT IN), then UNION ALL by name with
    missing columns null. AQE picks broadcast or shuffle for A's name set
    from its measured size; ``salted=True`` spreads names that hold a large
    share of B's rows over several tasks (``salted_join``). ``names`` has A's names
    in a column ``a_key`` where they can be had without A's rows.
    """
    from rankmart.operators.skew import salted_join

    # distinct is a partial aggregate: each map task ships one row per name.
    names = (a if names is None else names).select(normalise_name(a_key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    keyed = b.withColumn("_bk", normalise_name(b_key))
    if salted:
        extra = salted_join(keyed, names, "_bk", "_k", "left_anti")
    else:
        extra = keyed.join(names, F.col("_bk") == F.col("_k"), "left_anti")
    return a.unionByName(extra.drop("_bk"), allowMissingColumns=True)


def flagship_cut(df: DataFrame, as_of, months: int, strip_patterns, tiers, default_tier: int = 2,
                 model: str = "model", date: str = "date", tiebreak=None) -> DataFrame:
    """Recent rows only, then the highest tier and newest row per family.

    * recent: ``date`` at or after the as_of *time* minus ``months`` calendar
      months (month-end clamped), so with as_of at noon a row dated on the
      cutoff day is already too old;
    * family: ``model`` with each strip pattern applied once, in order;
    * tier: the first keyword contained in ``model`` (case-sensitive), else
      ``default_tier``;
    * per family: tier desc, date desc, then ``tiebreak`` (default: model).
    """
    from rankmart.functions.text import classify_first, family_key_suffix
    from rankmart.operators.dedup import keep_first

    cutoff = F.lit(str(as_of)).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(months)} MONTHS")
    recent = (df.filter(F.col(date).cast("timestamp_ntz") >= cutoff)
                .withColumn("_family", family_key_suffix(model, strip_patterns))
                .withColumn("_tier", classify_first(model, tiers, "contains", default_tier)))
    ties = tiebreak if tiebreak is not None else [F.col(model).asc()]
    return keep_first(recent, "_family", [F.col("_tier").desc(), F.col(date).desc(), *ties])
