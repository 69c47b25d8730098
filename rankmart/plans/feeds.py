"""Feed-shaped queries on the driver tables: JSON payloads, HTML extraction, newest
dated file, remote top-k, snapshot freshness and refresh status."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from pyspark.sql import types as T

from rankmart.operators import top_n
from rankmart.session import checkpoint_dir
from rankmart.sources.feeds import read_csv
from rankmart.plans import params as P
from rankmart.plans.registry import case_map, query, sql_list
from rankmart.sources import table
from rankmart.streaming import last_refresh, latest_snapshot


@query("src_json", """
WITH j AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS n_missing,
       sum(k)::BIGINT AS sum_k, max(k) AS max_k
FROM j GROUP BY event_type""")
def src_json(spark, sf):
    """JSON text column parsed with an explicit schema; missing/corrupt -> null."""
    ev = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.k").isNull()).alias("n_missing"),
        F.sum("p.k").cast("long").alias("sum_k"), F.max("p.k").alias("max_k"))


@query("html_json_extract", r"""
SELECT page_id,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?s)<script[^>]*>\s*(.*?)\s*</script>', 1) AS script
FROM pages""")
def html_json_extract(spark, sf):
    """Multi-line regex extraction from whole HTML pages (X23, the S9 mechanism)."""
    pg = table(spark, sf, "pages")
    return pg.select("page_id",
                     F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
                     F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
                     F.regexp_extract("html", r"(?s)<script[^>]*>\s*(.*?)\s*</script>", 1).alias("script"))


@query("latest_dated_file", f"""
WITH m AS (SELECT page_id, url, regexp_extract(url, '{P.PAGE_PATTERN}', 1) AS lang,
                  lpad(regexp_extract(url, '{P.PAGE_PATTERN}', 2), 8, '0') AS stamp
           FROM pages WHERE regexp_matches(url, '{P.PAGE_PATTERN}')),
  mx AS (SELECT lang, max(stamp) AS stamp FROM m GROUP BY lang)
SELECT m.lang, m.stamp, m.page_id, m.url FROM m JOIN mx USING (lang, stamp)""")
def latest_dated_file(spark, sf):
    """Per language, the pages carrying the newest (lexically largest) stamp in the URL."""
    pg = (table(spark, sf, "pages").filter(F.col("url").rlike(P.PAGE_PATTERN))
          .select("page_id", "url",
                  F.regexp_extract("url", P.PAGE_PATTERN, 1).alias("lang"),
                  F.lpad(F.regexp_extract("url", P.PAGE_PATTERN, 2), 8, "0").alias("stamp")))
    newest = pg.groupBy("lang").agg(F.max("stamp").alias("stamp"))
    return pg.join(newest, ["lang", "stamp"], "left_semi").select("lang", "stamp", "page_id", "url")


@query("src_topk", f"""
SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id, source, n_chars
FROM documents WHERE lang = '{P.TOPK_LANG}'
ORDER BY n_chars DESC, doc_id LIMIT {P.TOPK_N}""")
def src_topk(spark, sf):
    """Filter, sort, limit on the landed table: the hub API's remote top-k."""
    d = table(spark, sf, "documents").filter(F.col("lang") == P.TOPK_LANG).select("doc_id", "source", "n_chars")
    return top_n(d, [F.col("n_chars").desc(), F.col("doc_id").asc()], P.TOPK_N).select("rank", "doc_id", "source", "n_chars")


@query("snapshot_latest", f"""
WITH s AS (SELECT event_type AS source, ts AS fetched_at, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
           FROM events WHERE ts <= TIMESTAMP '{P.SN_AS_OF}')
SELECT source, fetched_at, event_id,
       round((epoch_us(TIMESTAMP '{P.SN_AS_OF}') - epoch_us(fetched_at)) / 1e6, 6) AS age_seconds,
       CAST({case_map('source', {k: str(v) for k, v in P.SN_TTLS.items()})} AS BIGINT) AS ttl_seconds,
       coalesce((epoch_us(TIMESTAMP '{P.SN_AS_OF}') - epoch_us(fetched_at)) / 1e6
                < CAST({case_map('source', {k: str(v) for k, v in P.SN_TTLS.items()})} AS BIGINT), false) AS is_fresh
FROM s WHERE rn = 1""")
def snapshot_latest(spark, sf):
    """Newest snapshot per source at as_of with its freshness."""
    snaps = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"),
                                              "event_id")
    out = latest_snapshot(snaps, P.SN_AS_OF, P.SN_TTLS, tiebreak=F.col("event_id").desc())
    return out.select("source", "fetched_at", "event_id", F.round("age_seconds", 6).alias("age_seconds"),
                      "ttl_seconds", "is_fresh")


@query("last_refresh", f"""
WITH dim AS (SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in P.SN_SOURCES)}) AS d(source)),
  l AS (SELECT event_type AS source, max(ts) AS last_fetched FROM events
        WHERE event_type IN ({sql_list(P.SN_SOURCES)}) GROUP BY event_type)
SELECT dim.source, l.last_fetched,
       CASE WHEN l.last_fetched IS NULL THEN dim.source || '  ·  Fetching...'
            ELSE dim.source || '  ·  Last refreshed: ' || strftime(l.last_fetched, '%Y-%m-%d %H:%M') || ' UTC' END AS status
FROM dim LEFT JOIN l USING (source)""")
def last_refresh_status(spark, sf):
    """Status line per listed source; a source never fetched shows Fetching...."""
    snaps = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"))
    return last_refresh(spark, snaps, P.SN_SOURCES)


_CSV_LANDED = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_mktsegment", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@query("src_csv", """
SELECT c_mktsegment, count(*) AS n,
       count(*) FILTER (WHERE NOT (c_acctbal >= 100)) AS n_missing_balance,
       round(sum(CASE WHEN c_acctbal >= 100 THEN c_acctbal END), 2) AS sum_balance
FROM customer GROUP BY c_mktsegment""")
def src_csv(spark, sf):
    """Land the table as CSV with header, "NaN" and blank cells, read it back with an explicit
    schema (S1-S4, N1, N3): "NaN" and blank become null and aggregates skip them.

    The files go to the cluster's shared checkpoint folder (one new folder per run).
    """
    landing = f"{checkpoint_dir(spark).rstrip('/')}/landed-csv/{uuid.uuid4().hex}"
    c = table(spark, sf, "customer")
    bal = (F.when(F.col("c_acctbal") < 0, F.lit("NaN"))
            .when(F.col("c_acctbal") < 100, F.lit(""))
            .otherwise(F.col("c_acctbal").cast("string")))
    (c.select("c_custkey", "c_name", "c_mktsegment", bal.alias("c_acctbal"))
      .write.option("header", True).option("emptyValue", "").mode("overwrite").csv(landing))
    back = read_csv(spark, landing, _CSV_LANDED)
    return back.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("c_acctbal").isNull()).alias("n_missing_balance"),
        F.round(F.sum("c_acctbal"), 2).alias("sum_balance"))
