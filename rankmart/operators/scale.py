"""Min-max scaling (optionally on log10) and group-median imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmart.functions.numeric import log_clip


def minmax_expr(col, mn, mx, lo: float, hi: float, fallback: float):
    """lo + (x - mn)/(mx - mn) * (hi - lo), or ``fallback`` when the range is empty.

    A null value stays null when there is a range; without a range every row
    gets the fallback (like the scalar in pandas).
    """
    c = F.col(col) if isinstance(col, str) else col
    mn = F.col(mn) if isinstance(mn, str) else mn
    mx = F.col(mx) if isinstance(mx, str) else mx
    return F.when(mx > mn, F.lit(float(lo)) + (c - mn) / (mx - mn) * F.lit(float(hi - lo))).otherwise(F.lit(float(fallback)))


def minmax_scale(df: DataFrame, col: str, lo: float, hi: float, fallback: float,
                 out: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """lo + (x - min)/(max - min) * (hi - lo); ``fallback`` when max == min.

    Bounds come from an aggregate, never an unkeyed window (which would pull
    all rows into one partition). Global bounds are one row (broadcast of a
    proven size); per-group bounds are a partial aggregate joined back on
    the group key, leaving the join strategy to AQE.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    bounds = (df.groupBy(*keys) if keys else df).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    joined = df.join(bounds, keys, "left") if keys else df.crossJoin(F.broadcast(bounds))
    return joined.withColumn(out, minmax_expr(col, "_mn", "_mx", lo, hi, fallback)).drop("_mn", "_mx")


def log_minmax(df: DataFrame, col: str, lo: float, hi: float, fallback: float, out: str,
               by: Sequence[str] | str | None = None, clip: float = 1.0) -> DataFrame:
    """Min-max of log10(max(x, clip)) (the dot sizes of the price and cluster maps)."""
    tmp = f"_log_{out}"
    return (minmax_scale(df.withColumn(tmp, log_clip(col, clip)), tmp, lo, hi, fallback, out, by)
              .drop(tmp))


def group_median(df: DataFrame, col: str, by: Sequence[str] | str, out: str = "median",
                 buckets: int = 256, accuracy: int = 10000) -> DataFrame:
    """Exact median per group (mean of the two middle values for an even count, like
    pandas), one row per group that has a non-null value. Skew-safe:

    1. distinct values are counted per group (a partial aggregate: a hot group
       is reduced map-side and spread over tasks by value);
    2. a bounded quantile sketch per group (``percentile_approx`` over its
       distinct values) cuts the group's values into ~``buckets`` ranges;
       counts per range give, with a
       window over at most ``buckets`` rows per group, the range that holds
       the middle rank;
    3. only the distinct values of that range are ranked exactly.

    No task ever holds a whole group: step 3 sees about 1/``buckets`` of a
    group's distinct values. (Spark's own ``median`` keeps a value->count map
    per group, which for a hot group with many distinct values is one task's
    memory.)
    """
    keys = [by] if isinstance(by, str) else list(by)
    vals = df.select(*keys, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    vc = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    probs = [i / buckets for i in range(1, buckets)]
    # ranges cut on the group's distinct values: the exact step below ranks distinct
    # values, so this balances its work (and the sketch reads fewer rows)
    bounds = vc.groupBy(*keys).agg(F.percentile_approx("_v", probs, accuracy).alias("_b"),
                                   F.sum("_c").alias("_n"))
    vb = (vc.join(bounds, keys)
            .withColumn("_k", F.size(F.filter("_b", lambda b: b < F.col("_v"))))
            .drop("_b"))
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.floor(F.col("_n") / 2)
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (vb.groupBy(*keys, "_k").agg(F.sum("_c").alias("_bc"), F.max("_n").alias("_n"))
                    .withColumn("_before", F.coalesce(F.sum("_bc").over(before), F.lit(0))))
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_bc"))
    target = per_bucket.filter(holds(lo) | holds(hi)).select(*keys, "_k", "_before", "_n")
    cand = vb.drop("_n").join(target, keys + ["_k"])
    w = Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    cand = cand.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("_start") <= r) & (r < F.col("_start") + F.col("_c")), F.col("_v")))
    picked = cand.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(out))


def impute_median(df: DataFrame, col: str, by: Sequence[str] | str, out: str,
                  method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Fill nulls with the group median (interpolated, like pandas).

    ``exact`` (default) is ``group_median``: exact and skew-safe.
    ``percentile`` is Spark's built-in exact median (simplest plan; memory per
    group grows with its distinct values). ``approx`` is percentile_approx
    with a bounded sketch. A group with only nulls keeps null.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if method == "exact":
        meds = group_median(df, col, keys, "_med")
    else:
        med = F.median(col) if method == "percentile" else F.percentile_approx(col, 0.5, accuracy)
        meds = df.groupBy(*keys).agg(med.cast("double").alias("_med"))
    return (df.join(meds, keys, "left")
              .withColumn(out, F.coalesce(F.col(col).cast("double"), F.col("_med")))
              .drop("_med"))
