"""Landed files as queries: newest landing by manifest (S11, X22), atomic publication."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from rankmart.plans import params as P
from rankmart.plans.registry import query
from rankmart.session import checkpoint_dir
from rankmart.sources import table
from rankmart.sources.manifest import list_files, newest_paths, read_manifest, record
from rankmart.sources.publish import Published, Refresh


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ newest landing

def land_by_day(spark, sf, root: str) -> str:
    """``pages`` landed as JSON in dated folders, a third of the days with each of three landings; returns the manifest's path."""
    pages = table(spark, sf, "pages").withColumn("day", F.pmod("page_id", F.lit(P.LD_DAYS)))
    stamp = F.date_format(F.date_add(F.lit(P.LD_FIRST_DAY).cast("date"), F.col("day").cast("int")), "yyyyMMdd")
    third = P.LD_DAYS // 3
    for batch in range(3):
        rows = pages.filter(F.col("day").between(batch * third, batch * third + third - 1))
        rows.withColumn("snapshot", stamp).drop("day").write.mode("append").partitionBy("snapshot").json(f"{root}/pages")
        files = list_files(spark, f"{root}/pages")
        if batch:  # files that the manifest doesn't have yet
            files = files.join(read_manifest(spark, f"{root}/manifest").select("path"), "path", "left_anti")
        record(files, f"{root}/manifest", batch)
    return f"{root}/manifest"


@query("newest_landing", f"""
SELECT page_id, url, length(html) AS n_chars,
       strftime(DATE '{P.LD_FIRST_DAY}' + CAST(page_id % {P.LD_DAYS} AS INTEGER), '%Y%m%d') AS stamp
FROM pages WHERE page_id % {P.LD_DAYS} = (SELECT max(page_id % {P.LD_DAYS}) FROM pages)""")
def newest_landing_pages(spark, sf):
    """Pages of the newest of many dated landings: the manifest names its folder, so the scan opens no other file."""
    root = scratch(spark, "newest-landing")
    paths = newest_paths(read_manifest(spark, land_by_day(spark, sf, root)))
    rows = spark.read.schema("page_id bigint, url string, html string").json(paths)
    return rows.select("page_id", "url", F.length("html").cast("long").alias("n_chars"),
                       F.regexp_extract(F.col("_metadata.file_path"), r"/snapshot=([^/]+)/", 1).alias("stamp"))


# ------------------------------------------------------------------ atomic publication

def _day_marts(spark, sf, as_of: str) -> dict:
    """Two marts of one refresh: totals per event type and per user cohort, up to a day."""
    ev = table(spark, sf, "events").filter(F.col("ts") < F.lit(as_of).cast("timestamp_ntz"))
    totals = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last_ts")]
    return {"by_type": ev.groupBy(F.col("event_type").alias("key")).agg(*totals),
            "by_cohort": ev.groupBy(F.concat(F.lit("cohort "), (F.col("user_id") % P.PB_COHORTS).cast("string")).alias("key")).agg(*totals)}


@query("published_marts", f"""
WITH e AS (SELECT * FROM events WHERE ts < TIMESTAMP '{P.PB_VERSIONS[1]}')
SELECT 'by_type' AS mart, event_type AS key, count(*) AS n, round(sum(value), 2) AS total, max(ts) AS last_ts FROM e GROUP BY event_type
UNION ALL
SELECT 'by_cohort', 'cohort ' || CAST(user_id % {P.PB_COHORTS} AS VARCHAR), count(*), round(sum(value), 2), max(ts) FROM e
GROUP BY user_id % {P.PB_COHORTS}""")
def published_marts(spark, sf):
    """Two refreshes published, a third aborted with one of its marts written: readers see the second, whole."""
    root = scratch(spark, "published")
    for as_of in P.PB_VERSIONS[:2]:
        with Refresh(spark, root) as refresh:
            for name, mart in _day_marts(spark, sf, as_of).items():
                refresh.put(name, mart)
    third = Refresh(spark, root)
    third.put("by_type", _day_marts(spark, sf, P.PB_VERSIONS[2])["by_type"])
    third.abort()
    seen = Published(spark, root)
    parts = [seen.read(name).select(F.lit(name).alias("mart"), "key", "n", "total", "last_ts") for name in seen.marts]
    return reduce(lambda a, b: a.unionByName(b), parts)
