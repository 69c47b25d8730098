"""One insight sentence per mart analog, as one table.

The header of a dashboard: each row is the ``insight`` of one KPI query,
computed from whole tables by that query's own plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rankmart.plans.registry import ORACLE, QUERIES, q, query

SOURCES = ["leaderboard_kpis", "decayed_downloads_kpis", "trending_kpis", "chip_share_stats",
           "price_latest_family_kpis", "rule_leaderboard_kpis", "context_kpis", "modality_kpis", "release_timeline_kpis", "geo_stats"]

_SQL = "\nUNION ALL\n".join(f"SELECT {q(name)} AS mart, insight FROM ({ORACLE[name]}) AS s{i}"
                            for i, name in enumerate(SOURCES))


@query("insights", _SQL)
def insights(spark, sf):
    """mart, insight: the sentence of every KPI query (each from its own whole-table plan)."""
    parts = [QUERIES[name](spark, sf).select(F.lit(name).alias("mart"), "insight") for name in SOURCES]
    return reduce(lambda a, b: a.unionByName(b), parts)
