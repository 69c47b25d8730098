"""Hardware marts on the driver tables: M6 maker share, M7 cluster map."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import log_clip, to_double
from rankmart.operators import (
    jitter_columns, log_minmax, map_lookup, minmax_expr, region_of, share_stats, top_n,
)
from rankmart.plans import params as P
from rankmart.plans.registry import case_map, q, query, spark_round, sql_list
from rankmart.sources import table

# ----------------------------------------------------------------------- M6

_CHIP_SQL = f"""
  cnt AS (SELECT n.n_name AS manufacturer, count(*) AS count
          FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
          WHERE n.n_name IS NOT NULL GROUP BY n.n_name),
  cc AS (SELECT manufacturer, count, coalesce({case_map('manufacturer', P.CHIP_COUNTRY)}, 'Other') AS country FROM cnt)"""


def chip_counts(spark, sf):
    """Rows per maker with its country.

    Customers are counted per nation key first (partial aggregate), so the
    join to the nation names sees one row per key, not one per customer.
    """
    per_key = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    named = per_key.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = (named.filter(F.col("n_name").isNotNull())
                   .groupBy(F.col("n_name").alias("manufacturer"))
                   .agg(F.sum("k").alias("count")))
    return counts.withColumn("country", map_lookup("manufacturer", P.CHIP_COUNTRY, "Other"))


@query("chip_share", f"""
WITH {_CHIP_SQL}
SELECT row_number() OVER (ORDER BY count DESC, manufacturer) AS rank, manufacturer, count, country
FROM cc ORDER BY count DESC, manufacturer LIMIT {P.CHIP_TOP_N}""")
def chip_share(spark, sf):
    """Top makers by row count with their country, "Other" when unmapped (M6)."""
    return top_n(chip_counts(spark, sf), [F.col("count").desc(), F.col("manufacturer").asc()], P.CHIP_TOP_N) \
        .select("rank", "manufacturer", "count", "country")


@query("chip_share_stats", f"""
WITH {_CHIP_SQL},
  t AS (SELECT manufacturer, count FROM cc ORDER BY count DESC, manufacturer LIMIT 1),
  k AS (SELECT (SELECT count(*) FROM customer) AS total,
       coalesce(sum(count) FILTER (WHERE country = 'US'), 0)::BIGINT AS us_count,
       count(DISTINCT manufacturer) FILTER (WHERE country = 'US') AS us_makers,
       coalesce(sum(count) FILTER (WHERE country = 'China'), 0)::BIGINT AS cn_count,
       count(DISTINCT manufacturer) FILTER (WHERE country = 'China') AS cn_makers,
       (SELECT manufacturer FROM t) AS top_maker, (SELECT count FROM t) AS top_count,
       round((SELECT count FROM t) / (SELECT count(*) FROM customer) * 100.0, 6) AS top_share
FROM cc),
  k2 AS (SELECT * FROM k)
SELECT *, printf({q(fixed.INSIGHT_CHIPS)}, top_maker, top_count, total, {spark_round('top_share', 0)},
                 cn_makers, cn_count, us_makers, us_count) AS insight
FROM k2""")
def chip_share_stats(spark, sf):
    """Totals over all makers, not just the shown top n."""
    counts = chip_counts(spark, sf)
    total = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total"))
    stats = share_stats(counts, "manufacturer", "country", total).withColumnRenamed("top_key", "top_maker")
    return stats.withColumn("insight", F.format_string(
        fixed.INSIGHT_CHIPS, "top_maker", "top_count", "total", F.round("top_share", 0),
        "cn_makers", "cn_count", "us_makers", "us_count"))


# ----------------------------------------------------------------------- M7

def geo_base(spark, sf):
    """Cluster rows with coordinates and region: all that counts and totals need."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    rows = (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
             .select(
                 "s_suppkey",
                 F.col("s_name").alias("name"),
                 F.col("r_name").alias("owner"),
                 F.col("n_name").alias("country"),
                 F.when(F.col("n_regionkey") != P.GEO_NO_COORD_REGION,
                        F.col("n_nationkey") * 6.0 - 70.0).alias("lat"),
                 (F.col("n_regionkey") * 60.0 - 120.0).alias("lon"),
                 F.coalesce(to_double(F.col("s_acctbal").cast("string")), F.lit(0.0)).alias("h100_equiv"),
                 to_double(F.when(F.col("s_acctbal") > 0, (F.col("s_acctbal") / 100).cast("string"))
                            .otherwise(F.lit("n/a"))).alias("power_mw"),
                 F.coalesce(F.col("s_acctbal") < 0, F.lit(False)).alias("anonymized"))
             .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    return rows.withColumn("region", region_of("country", P.GEO_REGION_MAP, P.GEO_EU))


def geo_rows(spark, sf):
    """The base rows with dot size and jitter, which need statistics of all rows."""
    rows = geo_base(spark, sf).withColumn("_lg", log_clip("h100_equiv"))
    # Both global statistics (dot-size bounds, flagged count) in one pass; one row, broadcast.
    stats = rows.agg(F.min("_lg").alias("_mn"), F.max("_lg").alias("_mx"),
                     F.count_if("anonymized").alias("_nf"))
    rows = rows.crossJoin(F.broadcast(stats)).withColumn("dot_size", minmax_expr("_lg", "_mn", "_mx", 4.0, 24.0, 10.0))
    rows = jitter_columns(rows, "anonymized", "_nf", F.col("s_suppkey"), "lat", "lon", seed=42)
    return rows.drop("_lg", "_mn", "_mx", "_nf")


_GEO_BASE = f"""
  g0 AS (SELECT s.s_suppkey, s.s_name AS name, r.r_name AS owner, n.n_name AS country,
                CASE WHEN n.n_regionkey <> {P.GEO_NO_COORD_REGION} THEN n.n_nationkey * 6.0 - 70.0 END AS lat,
                n.n_regionkey * 60.0 - 120.0 AS lon,
                coalesce(s.s_acctbal, 0.0) AS h100_equiv,
                CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal / 100 END AS power_mw,
                coalesce(s.s_acctbal < 0, false) AS anonymized
         FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
         JOIN region r ON n.n_regionkey = r.r_regionkey),
  g1 AS (SELECT *, coalesce({case_map('country', P.GEO_REGION_MAP)},
                            CASE WHEN country IN ({sql_list(P.GEO_EU)}) THEN 'Europe' END, 'Other') AS region,
                log10(greatest(h100_equiv, 1.0)) AS lg
         FROM g0 WHERE lat IS NOT NULL AND lon IS NOT NULL),
  b AS (SELECT min(lg) AS mn, max(lg) AS mx, count(*) FILTER (WHERE anonymized) AS nf FROM g1),
  geo AS (SELECT s_suppkey, name, owner, country, region,
                 CASE WHEN anonymized AND nf > 1 THEN lat + ((('0x' || substr(md5(CAST(s_suppkey AS VARCHAR) || ':42:lat'), 1, 8))::BIGINT / 4294967296.0) * 2.0 - 1.0) * 5.0 ELSE lat END AS lat,
                 CASE WHEN anonymized AND nf > 1 THEN lon + ((('0x' || substr(md5(CAST(s_suppkey AS VARCHAR) || ':42:lon'), 1, 8))::BIGINT / 4294967296.0) * 2.0 - 1.0) * 8.0 ELSE lon END AS lon,
                 h100_equiv, power_mw,
                 CASE WHEN mx > mn THEN 4.0 + (lg - mn) / (mx - mn) * 20.0 ELSE 10.0 END AS dot_size,
                 anonymized
          FROM g1, b)"""


@query("geo_jitter", f"""
WITH {_GEO_BASE}
SELECT s_suppkey, name, owner, country, region, round(lat, 6) AS lat, round(lon, 6) AS lon,
       h100_equiv, round(power_mw, 6) AS power_mw, round(dot_size, 6) AS dot_size, anonymized
FROM geo""")
def geo_jitter(spark, sf):
    """Cluster points with region, dot size and deterministic jitter of flagged rows (M7)."""
    g = geo_rows(spark, sf)
    return g.select("s_suppkey", "name", "owner", "country", "region",
                    F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "h100_equiv",
                    F.round("power_mw", 6).alias("power_mw"), F.round("dot_size", 6).alias("dot_size"),
                    "anonymized")


@query("geo_counts", f"""
WITH {_GEO_BASE}
SELECT region, anonymized, count(*) AS count FROM geo GROUP BY region, anonymized""")
def geo_counts(spark, sf):
    """Clusters per (region, anonymized)."""
    return geo_base(spark, sf).groupBy("region", "anonymized").agg(F.count(F.lit(1)).alias("count"))


@query("owner_totals", f"""
WITH {_GEO_BASE},
  o AS (SELECT owner, round(sum(h100_equiv), 6) AS h100_total FROM geo WHERE owner IS NOT NULL GROUP BY owner)
SELECT row_number() OVER (ORDER BY h100_total DESC, owner) AS rank, owner, h100_total
FROM o ORDER BY h100_total DESC, owner LIMIT {P.GEO_OWNER_TOP_N}""")
def owner_totals(spark, sf):
    """Capacity per owner, top n."""
    return top_owners(geo_base(spark, sf)).select("rank", "owner", "h100_total")


def top_owners(base):
    o = (base.filter(F.col("owner").isNotNull())
         .groupBy("owner").agg(F.round(F.sum("h100_equiv"), 6).alias("h100_total")))
    return top_n(o, [F.col("h100_total").desc(), F.col("owner").asc()], P.GEO_OWNER_TOP_N)


@query("geo_stats", f"""
WITH {_GEO_BASE},
  k AS (SELECT count(*) AS total_clusters, round(coalesce(sum(power_mw), 0.0), 6) AS total_mw,
       count(DISTINCT country) AS n_countries, count(*) FILTER (WHERE anonymized) AS n_anonymized,
       count(*) FILTER (WHERE region = 'United States') AS us_clusters,
       count(*) FILTER (WHERE region = 'China') AS cn_clusters
  FROM geo),
  o AS (SELECT owner, round(sum(h100_equiv), 6) AS h FROM geo WHERE owner IS NOT NULL GROUP BY owner ORDER BY h DESC, owner LIMIT {P.GEO_OWNER_TOP_N}),
  t AS (SELECT coalesce(string_agg(CASE WHEN h >= 1000000 THEN owner || ' (' || printf('%.1f', {spark_round('h / 1000000', 1)}) || 'M)'
                                   ELSE owner || ' (' || format('{{:,}}', CAST({spark_round('h / 1000', 0)} AS BIGINT)) || 'K)' END, ', ' ORDER BY h DESC, owner), '') AS owners FROM o)
SELECT k.*, printf({q(fixed.INSIGHT_GPU.replace('%,.0f', '%s'))}, total_clusters, n_countries, cn_clusters, us_clusters,
                   format('{{:,}}', CAST({spark_round('total_mw', 0)} AS BIGINT)), owners) AS insight
FROM k, t""")
def geo_stats(spark, sf):
    """Totals after the coordinate filter; an all-missing power column sums to 0 (N11);
    per-region counts are 0 when the region is absent; the sentence names the largest owners (A22, A23, X31)."""
    base = geo_base(spark, sf)
    k = base.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.round(F.coalesce(F.sum("power_mw"), F.lit(0.0)), 6).alias("total_mw"),
        F.count_distinct("country").alias("n_countries"),
        F.count_if("anonymized").alias("n_anonymized"),
        F.count_if(F.col("region") == "United States").alias("us_clusters"),
        F.count_if(F.col("region") == "China").alias("cn_clusters"))
    h = F.col("h100_total")
    part = (F.when(h >= 1_000_000, F.format_string(fixed.OWNER_MILLIONS, "owner", F.round(h / 1_000_000, 1)))
             .otherwise(F.format_string(fixed.OWNER_THOUSANDS, "owner", F.round(h / 1_000, 0))))
    shown = F.array_sort(F.collect_list(F.struct("rank", "part")))  # at most the top owners
    owners = top_owners(base).withColumn("part", part).agg(F.array_join(F.transform(shown, lambda x: x["part"]), ", ").alias("owners"))
    one = k.crossJoin(F.broadcast(owners))  # one row each
    sentence = F.format_string(fixed.INSIGHT_GPU, "total_clusters", "n_countries", "cn_clusters", "us_clusters", F.round("total_mw", 0), "owners")
    return one.select(*k.columns, sentence.alias("insight"))


@query("log_size_scale", """
WITH s AS (SELECT s_suppkey, s_acctbal, log10(CASE WHEN s_acctbal IS NOT NULL THEN greatest(s_acctbal, 1.0) END) AS lg FROM supplier),
  b AS (SELECT min(lg) AS mn, max(lg) AS mx FROM s)
SELECT s_suppkey, s_acctbal,
       round(CASE WHEN mx > mn THEN 4.0 + (lg - mn) / (mx - mn) * 20.0 ELSE 10.0 END, 6) AS dot_size
FROM s, b""")
def log_size_scale(spark, sf):
    """log10 of the value clipped at 1, scaled to 4-24 with fallback 10."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return log_minmax(s, "s_acctbal", 4.0, 24.0, 10.0, "dot_size") \
        .select("s_suppkey", "s_acctbal", F.round("dot_size", 6).alias("dot_size"))
