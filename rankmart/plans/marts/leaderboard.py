"""M1 leaderboard matrix and its insight row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import nan_to_null, map_lookup_inverse
from rankmart.operators import rank_matrix, zscore_scores


# ----------------------------------------------------------------------- M1

def leaderboard_scores(bench: DataFrame, category_map: dict = fixed.CATEGORY_MAP, check: bool = True) -> DataFrame:
    """Mapped benchmark rows -> qualified (model_group, category, performance, z)."""
    known = [b for bs in category_map.values() for b in bs]
    rows = (bench.filter(F.col("benchmark").isin(known))
                 .withColumn("category", map_lookup_inverse(F.col("benchmark"), category_map))
                 # NaN would win Spark's max (pandas skips it): missing is null
                 .withColumn("performance", nan_to_null(F.col("performance").cast("double"))))
    if check and rows.isEmpty():
        sample = [r[0] for r in bench.select("benchmark").distinct().limit(20).collect()]
        raise ValueError(f"none of the {len(known)} mapped benchmarks is in the feed; it has {sample}")
    return zscore_scores(rows, "model_group", "category", "performance",
                         len(category_map) - 1, len(category_map))


def leaderboard_matrix(bench: DataFrame, category_map: dict = fixed.CATEGORY_MAP,
                       top_n_: int = fixed.LEADERBOARD_TOP_N) -> DataFrame:
    """rank, model_group, avg_z, one column per category in display order (x100)."""
    scores = leaderboard_scores(bench, category_map)
    return rank_matrix(scores, "model_group", "category", list(category_map), "performance", top_n_, 100.0)


def leaderboard_insight(bench: DataFrame, category_map: dict = fixed.CATEGORY_MAP,
                        top_n_: int = fixed.LEADERBOARD_TOP_N) -> DataFrame:
    """last_date, total_evaluated, num_dropped (over the whole input), leader and its best category."""
    cats = list(category_map)
    known = [b for bs in category_map.values() for b in bs]
    wide = leaderboard_matrix(bench, category_map, top_n_)
    best = None
    for c in cats:
        hit = F.col(f"`{c}`") == F.col("best_value")
        best = F.when(hit, F.lit(c)) if best is None else best.when(hit, F.lit(c))
    lead = (wide.filter(F.col("rank") == 1)
                .withColumn("best_value", F.greatest(*[F.col(f"`{c}`") for c in cats]))
                .select(F.col("model_group").alias("top_model"), best.alias("best_category"), "best_value"))
    k = bench.agg(F.count_distinct("model_group").alias("total_evaluated"),
                  F.max(F.when(F.col("benchmark").isin(known), F.col("date"))).alias("last_date"))
    shown = wide.agg(F.count(F.lit(1)).alias("n_shown"))
    out = (k.crossJoin(shown).crossJoin(lead)
             .withColumn("num_dropped", F.col("total_evaluated") - F.col("n_shown")))
    return out.withColumn("insight", F.format_string(
        fixed.INSIGHT_LEADERBOARD,
        "top_model", "best_category", F.round("best_value", 1), "n_shown", "total_evaluated", "num_dropped"))
