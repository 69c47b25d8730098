"""Range lookup against a table of intervals (J9, A11): equi-joins on grid cells instead of a nested loop.

An interval of width w lives on the level of the grid whose cells are the smallest power of two not below w, where it touches
two cells at most. A value probes the one cell that holds it on each level in use, and an exact comparison decides. Wide and
narrow intervals can be mixed freely: none is cut into more than two rows, and a value probes as many times as there
are levels, which the widths bound (a factor of a thousand between them is ten levels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = 2000  # the level of intervals without one end: a cell for everything


def _level(width: Column) -> Column:
    """The exponent of the smallest power of two that isn't below the width (rounding up once more does no harm)."""
    return F.when(width > 0, F.ceil(F.log2(width))).otherwise(F.lit(-60)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def on_grid(intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The intervals with _level and _cell, one row per cell touched (one or two). Null ends are open; an interval whose low
    end is above its high end holds nothing and is left out."""
    a, z = F.col(lo).cast("double"), F.col(hi).cast("double")
    rows = intervals.filter(a.isNull() | z.isNull() | (a <= z))
    # beside huge ends a narrow interval's cells would be finer than a double can tell
    fine = F.greatest(_level(z - a), F.ceil(F.log2(F.greatest(F.abs(a), F.abs(z), F.lit(1e-300)))).cast("int") - 50)
    rows = rows.withColumn("_level", F.when(a.isNull() | z.isNull(), F.lit(OPEN)).otherwise(fine))
    cells = F.when(F.col("_level") == OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(_cell(a, F.col("_level")), _cell(z, F.col("_level"))))
    return rows.withColumn("_cell", F.explode(cells))


def interval_join(facts: DataFrame, value: str, intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every fact row with every interval that holds its value, both ends included. Null values are in none."""
    grid = on_grid(intervals, lo, hi)
    levels = sorted(r[0] for r in grid.select("_level").distinct().collect())  # one row per level in use
    v = F.col(value).cast("double")
    probe = F.array(*[F.struct(F.lit(n).alias("l"), (F.lit(0).cast("long") if n == OPEN else _cell(v, F.lit(n))).alias("c")) for n in levels])
    rows = facts.filter(F.col(value).isNotNull())
    if not levels:
        return rows.crossJoin(intervals.limit(0))
    rows = rows.withColumn("_p", F.explode(probe)).select(*facts.columns, F.col("_p.l").alias("_level"), F.col("_p.c").alias("_cell"))
    inside = (F.coalesce(F.col(value) >= F.col(lo), F.lit(True))) & (F.coalesce(F.col(value) <= F.col(hi), F.lit(True)))
    return rows.join(grid, ["_level", "_cell"]).filter(inside).drop("_level", "_cell")


def interval_counts(facts: DataFrame, value: str, intervals: DataFrame, key: str, lo: str = "lo", hi: str = "hi", total: str | None = None) -> DataFrame:
    """The intervals with ``count`` of the facts they hold (and ``sum`` of ``total``), empty ones with 0.

    Equal values are added up before they meet the intervals.
    """
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(total).alias("_s")] if total else [])
    per = facts.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(*sums)
    hits = interval_join(per, "_v", intervals.select(F.col(key).alias("_key"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), "_lo", "_hi")
    found = hits.groupBy("_key").agg(F.sum("_n").alias("count"), *([F.sum("_s").alias("sum")] if total else []))
    out = intervals.join(found, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return out


def first_interval(facts: DataFrame, value: str, intervals: DataFrame, order: str, lo: str = "lo", hi: str = "hi", out: str = "interval") -> DataFrame:
    """``facts`` with the smallest ``order`` of the intervals that hold the value, null if none does (the ordered "first
    range wins" of ``bucketize`` for a table of ranges)."""
    values = facts.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct()
    best = (interval_join(values, "_v", intervals.select(F.col(order).alias("_o"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), "_lo", "_hi")
            .groupBy("_v").agg(F.min("_o").alias(out)))
    return facts.join(best, F.col(value) == F.col("_v"), "left").drop("_v")
