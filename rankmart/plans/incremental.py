"""Marts kept by merging landed batches (T3), against their one-shot answers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import map_lookup_inverse
from rankmart.plans import params as P
from rankmart.plans.landing import scratch
from rankmart.plans.leaderboard import CATS
from rankmart.plans.registry import ORACLE, query
from rankmart.sources import table
from rankmart.sources.publish import Published
from rankmart.sources.tables import SCHEMAS
from rankmart.streaming.incremental import decayed, leaderboard, merge_decayed, merge_leaderboard, part, start_incremental


def _cells(ev):
    entity = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string"))
    return ev.select(entity.alias("entity"), map_lookup_inverse(F.col("event_type"), P.LB_CATEGORIES).alias("category"), F.col("value").alias("score"))


def _dated(ev):
    """Rows of a tenth of the users have no date."""
    return ev.select(F.col("event_type").alias("key"), "value", F.when(F.col("user_id") % 10 != 0, F.to_date("ts")).alias("date"))


PARTS = {
    "leaderboard": (_cells, partial(merge_leaderboard, min_categories=P.LB_MIN_CATEGORIES)),
    "decayed": (_dated, partial(merge_decayed, k=fixed.DECAY_K, half_life_days=fixed.HALF_LIFE_DAYS)),
}


def land_and_merge(spark, sf, root: str) -> Published:
    """``events`` landed in three batches, out of time order, each merged into the state by the landing stream."""
    for batch in range(3):
        table(spark, sf, "events").filter(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{root}/landed")
        start_incremental(stream, PARTS, f"{root}/state", "events", checkpoint=f"{root}/checkpoint").awaitTermination()
    return Published(spark, f"{root}/state")


@query("incremental_leaderboard", ORACLE["zscore_leaderboard"])
def incremental_leaderboard(spark, sf):
    """The z-score leaderboard from cells and category sums merged batch by batch."""
    state = part(land_and_merge(spark, sf, scratch(spark, "incremental")), "leaderboard")
    out = leaderboard(state, CATS, P.LB_MIN_CATEGORIES, P.LB_TOP_N, P.LB_SCALE)
    return out.select("rank", "entity", F.round("avg_z", 6).alias("avg_z"), *CATS)


@query("incremental_decayed", f"""
SELECT event_type, CAST(trunc(round(sum(value * exp(-{fixed.DECAY_K} * CASE WHEN user_id % 10 <> 0
         THEN date_diff('day', CAST(ts AS DATE), DATE '{P.IN_AS_OF}') ELSE {fixed.MISSING_AGE_DAYS} END / {float(fixed.HALF_LIFE_DAYS)})), 6)) AS BIGINT) AS total,
       count(*) AS n
FROM events GROUP BY event_type""")
def incremental_decayed(spark, sf):
    """Decayed totals per event type from sums carried on from batch to batch."""
    state = part(land_and_merge(spark, sf, scratch(spark, "incremental")), "decayed")
    out = decayed(state, P.IN_AS_OF, fixed.DECAY_K, fixed.HALF_LIFE_DAYS, fixed.MISSING_AGE_DAYS)
    return out.select(F.col("key").alias("event_type"), "total", F.col("count").alias("n"))
