"""Frequency shares and conditional totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_share(df: DataFrame, key: str, out_key: str | None = None) -> DataFrame:
    """Count per non-null value (pandas value_counts drops nulls, N2)."""
    out_key = out_key or key
    return (df.filter(F.col(key).isNotNull())
              .groupBy(F.col(key).alias(out_key))
              .agg(F.count(F.lit(1)).alias("count")))


def share_stats(counts: DataFrame, key: str, group: str, total_rows: DataFrame,
                groups=("US", "China"), labels=("us", "cn")) -> DataFrame:
    """One row: per-group row totals and distinct keys, the top key and its share %.

    ``counts`` is the (key, count, group) table; ``total_rows`` a one-row
    frame with column ``total``: the source row count, nulls included (like
    len(df)). Top key: most rows, ties by key.
    """
    aggs = []
    for g, lab in zip(groups, labels):
        aggs.append(F.coalesce(F.sum(F.when(F.col(group) == g, F.col("count"))), F.lit(0)).cast("long").alias(f"{lab}_count"))
        aggs.append(F.count_distinct(F.when(F.col(group) == g, F.col(key))).alias(f"{lab}_makers"))
    top = F.min(F.struct((-F.col("count")).alias("neg"), F.col(key).alias("k"), F.col("count").alias("n")))
    one = counts.agg(*aggs, top.alias("_top")).crossJoin(F.broadcast(total_rows))  # one row each
    return (one.select("total", *[c for c in one.columns if c not in ("_top", "total")],
                       F.col("_top.k").alias("top_key"), F.col("_top.n").alias("top_count"))
               .withColumn("top_share", F.round(F.col("top_count") / F.col("total") * 100.0, 6)))
