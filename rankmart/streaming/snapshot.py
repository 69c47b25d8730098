"""Newest snapshot per source with a freshness flag (T1) and refresh status.

The in-process TTL caches of a dashboard become a landed snapshot table
(source, fetched_at, payload...); these operators pick from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions.dates import epoch_utc_label
from rankmart.operators.dedup import keep_first
from rankmart.operators.lookup import map_lookup


def _ts(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")


def latest_snapshot(df: DataFrame, as_of, ttls: dict, source: str = "source", fetched_at: str = "fetched_at",
                    tiebreak=None, default_ttl: int | None = None, require=None) -> DataFrame:
    """Newest row per source; ``is_fresh`` when younger than the source's TTL (seconds).

    A stale snapshot is still returned (stale fallback). ``require`` lists
    sources that must have a snapshot: the job fails naming the missing ones
    (the "no cache available" error). The newest-per-source cut is a
    row_number limit that also runs before the shuffle, so a source with
    very many snapshots costs one row per map task.
    """
    order = [F.col(fetched_at).desc()] + ([tiebreak] if tiebreak is not None else [])
    newest = keep_first(df.filter(F.col(fetched_at) <= _ts(as_of)), source, order)
    age = (F.unix_micros(_ts(as_of).cast("timestamp")) - F.unix_micros(F.col(fetched_at).cast("timestamp"))) / 1e6
    ttl = map_lookup(source, {k: int(v) for k, v in ttls.items()},
                     None if default_ttl is None else int(default_ttl))
    out = (newest.withColumn("age_seconds", age)
                 .withColumn("ttl_seconds", ttl.cast("long"))
                 .withColumn("is_fresh", F.coalesce(F.col("age_seconds") < F.col("ttl_seconds"), F.lit(False))))
    if require:
        have = {r[0] for r in out.select(source).filter(F.col(source).isin(list(require))).distinct().collect()}
        missing = sorted(set(require) - have)
        if missing:
            raise RuntimeError(f"no snapshot available for: {', '.join(missing)}")
    return out


def last_refresh(spark: SparkSession, df: DataFrame, sources, source: str = "source",
                 fetched_at: str = "fetched_at", labels: dict | None = None) -> DataFrame:
    """One status row per listed source: last fetch time and a display label.

    A source never fetched shows "Fetching...". The per-source max is a
    partial aggregate; the source list is a literal (bounded) dimension.
    """
    labels = labels or {}
    dim = spark.createDataFrame([(s, labels.get(s, s)) for s in sources], "source string, source_label string")
    last = df.groupBy(F.col(source).alias("source")).agg(F.max(fetched_at).alias("last_fetched"))
    epoch = F.unix_seconds(F.col("last_fetched").cast("timestamp"))
    text = F.when(F.col("last_fetched").isNull(), F.concat("source_label", F.lit(fixed.STATUS_FETCHING)))\
            .otherwise(F.concat("source_label", F.lit(fixed.STATUS_REFRESHED), epoch_utc_label(epoch)))
    return dim.join(F.broadcast(last.join(F.broadcast(dim.select("source")), "source", "left_semi")), "source", "left") \
              .select("source", "last_fetched", text.alias("status"))
