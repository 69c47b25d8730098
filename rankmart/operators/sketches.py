"""Mergeable summaries: distinct counts over any range of days (A2), heavy hitters without a full count."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.operators.dedup import top_n

LG_K = 12  # 2^12 registers: a standard error of 1.04 / 64 = 1.6 %


def relative_error(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Bound on the sketch's relative error at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(2 ** lg_k)


def distinct_sketches(df: DataFrame, by: list[str], item: str, lg_k: int = LG_K) -> DataFrame:
    """One HLL sketch of ``item`` per group (for example per category and day), in column ``sketch``. Rows of later snapshots give
    sketches of their own; united they answer for all of them, and a row seen twice counts once."""
    return df.filter(F.col(item).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(item, lg_k).alias("sketch"))


def distinct_over(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct items per group of the sketches given: a range of days is a filter on the sketch table, which
    has one row per group and day however many rows were counted."""
    union = F.hll_union_agg("sketch", F.lit(True))
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(union).alias("estimate"))


def heavy_hitters(df: DataFrame, item: str, n: int, tracked: int = 10_000, candidates: int | None = None) -> tuple[DataFrame, bool]:
    """The ``n`` most frequent items with exact counts (rank, item, n; ties by item), and whether the sketch proved the answer.

    First pass: a frequent-items sketch of at most ``tracked`` items per task, merged into one row. Its estimates are upper
    bounds; an item that it doesn't report occurs at most 2 x 3.5 / size x rows times. Second pass: exact counts of the
    ``candidates`` (default 10 n) largest estimates, selected by a semi join with that bounded list. If the n-th exact
    count is above all that any other item can have, nothing was missed. Otherwise (flat data, or ties at the
    border) the items are counted in full, so the answer is always exact; the flag tells which way it came.
    """
    rows = df.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"))
    want = candidates or 10 * n
    if tracked < want:
        raise ValueError("track at least as many items as there are candidates")
    sketch = rows.agg(F.expr(f"approx_top_k_accumulate(item, {int(tracked)})").alias("s"), F.count(F.lit(1)).alias("rows"))
    one = sketch.select("rows", F.expr(f"approx_top_k_estimate(s, {int(want)})").alias("top")).first()  # one row of at most ``want`` items
    order = [F.col("n").desc(), F.col("item").asc()]
    if not one["rows"]:
        return top_n(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")), order, n), True
    size = 1 << max(3, math.ceil(math.log2(tracked / 0.75)))
    unseen = 7 / size * one["rows"]
    listed = one["top"][-1]["count"] if len(one["top"]) >= want else 0  # no other tracked item has a larger estimate
    spark = df.sparkSession
    some = spark.createDataFrame([(r["item"],) for r in one["top"]], rows.schema)
    exact = rows.join(F.broadcast(some), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    counted = sorted((r["n"] for r in exact.collect()), reverse=True)  # at most ``want`` rows
    bound = max(listed, unseen)
    proved = len(counted) >= n and counted[n - 1] > bound or bound < 1
    full = exact if proved else rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return top_n(full, order, n), proved
