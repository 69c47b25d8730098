"""Inclusive range buckets with zero fill and top examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart.operators.dedup import keep_first


def bucketize(c, buckets: Sequence[tuple]) -> Column:
    """1-based ordinal of the first (label, lo, hi) range holding the value, both ends
    inclusive; ``hi=None`` is unbounded. Outside every range -> null.

    One ``when`` chain instead of a range join: a dimension-driven range join
    plans as a nested-loop join.
    """
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for i, (_, lo, hi) in enumerate(buckets, start=1):
        cond = c >= F.lit(lo) if hi is None else c.between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def bucket_counts(spark: SparkSession, df: DataFrame, value: str, name: str,
                  buckets: Sequence[tuple], tiebreak, examples: int = 3,
                  none_text: str = "—", sep: str = ", ") -> DataFrame:
    """One row per bucket, empty ones included: ord, bucket, count, examples.

    ``examples`` are the names of the largest values in the bucket (ties by
    ``tiebreak``), joined with ``sep``; ``none_text`` when the bucket is empty.
    Counts are a partial aggregate; examples a top-k per bucket that is cut
    to ``examples`` rows per map task before the shuffle. Both results hold
    at most len(buckets) rows, so joining them to the bucket list is a
    broadcast of bounded size.
    """
    labelled = (df.withColumn("ord", bucketize(value, buckets))
                  .filter(F.col("ord").isNotNull()))
    counts = labelled.groupBy("ord").agg(F.count(F.lit(1)).alias("count"))
    top = keep_first(labelled, "ord", [F.col(value).desc(), tiebreak], n=examples, rank_col="rn")
    ex = (top.groupBy("ord")
             .agg(F.array_join(
                 F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(name).cast("string").alias("n")))),
                             lambda s: s["n"]), sep).alias("examples")))
    dim = spark.createDataFrame([(i, lab) for i, (lab, _, _) in enumerate(buckets, start=1)],
                                "ord int, bucket string")
    return (dim.join(F.broadcast(counts), "ord", "left")
               .join(F.broadcast(ex), "ord", "left")
               .select("ord", "bucket",
                       F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                       F.coalesce(F.col("examples"), F.lit(none_text)).alias("examples")))
