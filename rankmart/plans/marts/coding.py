"""M11 coding leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import classify_first
from rankmart.operators import top_n


# ---------------------------------------------------------------------- M11

def coding_leaderboard(results: DataFrame, top_n_: int = fixed.SWEBENCH_TOP_N) -> DataFrame:
    rows = results.withColumn("_score", F.coalesce("resolved", F.lit(0.0)))
    top = top_n(rows, [F.col("_score").desc(), F.col("src_pos").asc()], top_n_)
    return top.select(
        "rank", F.coalesce("name", F.lit(fixed.UNKNOWN)).alias("name"), F.col("_score").alias("resolved"),
        classify_first(F.coalesce("name", F.lit("")), fixed.SWEBENCH_ORG_PATTERNS, "contains_ci", fixed.OTHER).alias("org"),
        F.coalesce("date", F.lit("")).alias("date"),
        (F.coalesce("os_model", F.lit(False)) | F.coalesce("os_system", F.lit(False))).alias("is_open"))


def coding_insight(board: DataFrame) -> DataFrame:
    lead = F.min(F.struct(F.col("rank").alias("r"), F.col("name").alias("n"), F.col("resolved").alias("s")))
    one = board.agg(lead.alias("l"), F.count_if("is_open").alias("open_count"), F.count(F.lit(1)).alias("shown"))
    one = one.select(F.col("l.n").alias("leader"), F.col("l.s").alias("resolved"), "open_count", "shown")
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_CODING,
        "leader", F.round("resolved", 1), "open_count", "shown"))
