"""Landed nested documents as queries: variants of drifting shape (S5, S9, X24), quarantine scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart.plans import params as P
from rankmart.plans.landing import scratch
from rankmart.plans.registry import query
from rankmart.sources import table
from rankmart.sources.quarantine import scan
from rankmart.sources.variant import category_results, field

# ------------------------------------------------------------------ drifting documents


def land_drifting_pages(spark, sf, path: str) -> None:
    """``events`` in pages of ``VA_EVENTS`` each, embedded as JSON: categories by event type in order of their first event,
    results in event order. Some results lack ``k``, hold ``value`` as text, or have further fields; some pages have no
    or broken JSON. A page is bounded, so its array is too."""
    ev = table(spark, sf, "events").withColumn("page", F.expr(f"event_id div {P.VA_EVENTS}")).withColumn("k", F.from_json("props", "k int")["k"])
    value = F.col("value").cast("string")
    number = F.concat(F.lit('"value":'), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value))
    parts = [F.concat(F.lit('"event_id":'), F.col("event_id").cast("string")), number,
             F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('"k":'), F.col("k").cast("string"))),
             F.when(F.col("event_id") % 4 == 0, F.lit('"agent":{"v":2}')), F.when(F.col("event_id") % 8 == 0, F.lit('"beta":null'))]
    one = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    cats = ev.groupBy("page", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("r")))).alias("rs"))
    results = F.concat_ws(",", F.transform("rs", lambda x: x["r"]))
    cat = F.concat(F.lit('{"name":"'), "event_type", F.lit('","results":['), results, F.lit("]}"))
    cats = cats.select("page", F.col("rs")[0]["event_id"].alias("first"), cat.alias("c"))
    pages = cats.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("first", "c"))).alias("cs"))
    pages = pages.select("page", F.concat(F.lit("["), F.concat_ws(",", F.transform("cs", lambda x: x["c"])), F.lit("]")).alias("data"))
    data = F.when(F.col("page") % 13 == 5, F.expr("substring(data, 1, length(data) - 9)")).otherwise(F.col("data"))
    script = F.concat(F.lit('<script type="application/json" id="leaderboard-data">\n'), data, F.lit("\n</script>"))
    html = F.concat(F.lit("<html><body><h1>page "), F.col("page").cast("string"), F.lit("</h1>"), F.when(F.col("page") % 13 != 7, script).otherwise(""),
                    F.lit("</body></html>"))
    pages.select("page", html.alias("html")).write.mode("overwrite").parquet(path)


@query("variant_results", f"""
WITH e AS (SELECT *, event_id // {P.VA_EVENTS} AS page, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  named AS (SELECT page, coalesce(max(event_type) FILTER (WHERE event_type = '{P.VA_CATEGORY}'), min_by(event_type, event_id)) AS category
            FROM e WHERE page % 13 NOT IN (5, 7) GROUP BY page)
SELECT e.page, category, CAST(row_number() OVER (PARTITION BY e.page ORDER BY event_id) - 1 AS INTEGER) AS src_pos, event_id, value,
       CASE WHEN event_id % 3 <> 0 THEN k END AS k,
       CASE WHEN event_id % 8 = 0 THEN 'agent,beta' WHEN event_id % 4 = 0 THEN 'agent' ELSE '' END AS unknown
FROM e JOIN named ON e.page = named.page AND e.event_type = named.category""")
def variant_results(spark, sf):
    """Embedded documents of drifting shape: the named category or the first, its results with positions, missing and
    further fields, numbers held as text (S5 S9 X23 X24)."""
    path = scratch(spark, "drifting-pages")
    land_drifting_pages(spark, sf, path)
    pages = spark.read.schema("page bigint, html string").parquet(path)
    rows = category_results(pages, "html", P.VA_PATTERN, P.VA_CATEGORY, {"event_id": "bigint", "value": "double", "k": "int"}, keep=["page"])
    return rows.withColumn("unknown", F.array_join("unknown", ","))


# ------------------------------------------------------------------ quarantine

def land_packages(spark, sf, path: str) -> None:
    """``events`` as one JSON file per type and ``QU_EVENTS`` events, some of them truncated, empty, without data or of another type."""
    ev = table(spark, sf, "events").withColumn("part", F.expr(f"event_id div {P.QU_EVENTS}"))
    # a package holds a bounded number of events, so this is a row per file
    docs = ev.groupBy("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    text = F.to_json(F.struct(F.col("event_type").alias("package"), F.struct("n", "total").alias("data")))
    docs = docs.withColumn("t", text).withColumn("kind", F.col("part") % 7)
    broken = (F.when(F.col("kind") == 1, F.expr("substring(t, 1, 20 + length(t) div 3)")).when(F.col("kind") == 3, "")
               .when(F.col("kind") == 4, "<html>429</html>").when(F.col("kind") == 5, F.to_json(F.struct(F.col("event_type").alias("package"))))
               .when(F.col("kind") == 6, F.regexp_replace("t", '"n":[0-9]+', '"n":"many"')).otherwise(F.col("t")))
    # a file costs a task far more than its row does, so the rows are dealt out, whatever little they weigh, and each task moves its own files into place
    rows = docs.select("event_type", broken.alias("value"), "part").repartition(4 * spark.sparkContext.defaultParallelism, "event_type", "part").drop("part")
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("event_type").text(path)


@query("quarantine_scan", f"""
WITH d AS (SELECT event_type, event_id // {P.QU_EVENTS} AS part, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL),
  r AS (SELECT *, CASE part % 7 WHEN 1 THEN 'truncated' WHEN 3 THEN 'empty' WHEN 4 THEN 'not json' WHEN 5 THEN 'missing data.n'
                  WHEN 6 THEN 'wrong type data.n' ELSE 'good' END AS reason FROM d)
SELECT event_type, reason, count(*) AS files, CAST(sum(CASE WHEN reason = 'good' THEN n END) AS BIGINT) AS n,
       round(sum(CASE WHEN reason = 'good' THEN total END), 2) AS total
FROM r GROUP BY event_type, reason""")
def quarantine_scan(spark, sf):
    """Package files scanned once: totals of the good ones, files and reasons of the quarantined ones."""
    root = scratch(spark, "quarantine")
    land_packages(spark, sf, f"{root}/landed")
    good, bad = scan(spark, f"{root}/landed", {"package": "string", "data.n": "bigint", "data.total": "double"}, f"{root}/judged")
    files = F.count(F.lit(1)).alias("files")
    fine = good.groupBy("event_type", F.lit("good").alias("reason")).agg(
        files, F.sum(field(F.col("doc"), "data.n", "bigint")).alias("n"), F.round(F.sum(field(F.col("doc"), "data.total", "double")), 2).alias("total"))
    held = bad.groupBy("event_type", "reason").agg(files).select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    return fine.unionByName(held)
