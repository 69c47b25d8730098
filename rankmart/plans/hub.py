"""Hub-style marts on the driver tables: M8 decayed downloads, M9 trending,
M10 modality champions, M12 package downloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart.functions import age_days, iso_prefix_date, org_of, short_name, short_number
from rankmart.operators import keep_first, lookup, map_lookup, top_n
from rankmart.operators.decay import decay_column, decayed_sum
from rankmart import fixed
from rankmart.plans import params as P
from rankmart.plans.registry import case_map, q, query, sql_list
from rankmart.sources import table

# ----------------------------------------------------------------------- M8

_DD_ORG = "(CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE 'community' END)"
_DD_SQL_BASE = f"""
  w AS (SELECT l_suppkey, CAST(l_quantity * {P.DD_DOWNLOADS_SCALE} AS BIGINT) AS downloads,
               exp(-0.693 * greatest(coalesce(date_diff('day',
                   TRY_CAST(substr(CAST(l_shipdate AS VARCHAR), 1, 10) AS DATE),
                   DATE '{P.DD_AS_OF}'), 365), 0) / 60.0) AS weight
        FROM lineitem),
  s AS (SELECT s.s_suppkey, n.n_name || '/' || s.s_name AS id
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
  o AS (SELECT {_DD_ORG} AS org, w.downloads, w.weight FROM w JOIN s ON w.l_suppkey = s.s_suppkey),
  g AS (SELECT org, CAST(trunc(round(sum(downloads * weight), 6)) AS BIGINT) AS downloads,
               count(*) AS model_count
        FROM o WHERE org NOT IN ({sql_list(P.DD_EXCLUDED_ORGS)}) GROUP BY org),
  top AS (SELECT row_number() OVER (ORDER BY downloads DESC, org) AS rank, org,
                 coalesce({case_map('org', P.DD_DISPLAY)}, org) AS display_name, downloads, model_count
          FROM g ORDER BY downloads DESC, org LIMIT {P.DD_TOP_N})"""

_SHORT_SQL = """(CASE WHEN {c} >= 1000000 THEN CAST(CAST(round({c} / 1000000.0, 0) AS BIGINT) AS VARCHAR) || 'M'
      WHEN {c} >= 1000 THEN CAST(CAST(round({c} / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'K'
      ELSE CAST(CAST({c} AS BIGINT) AS VARCHAR) END)"""


def dd_orgs(spark, sf):
    """Per-org decayed downloads (all orgs, before the top-n cut).

    The decayed sum is pre-aggregated per supplier *before* the supplier /
    nation joins: the fact table shrinks to one row per supplier before any
    join shuffle, and the org-level sum adds those partial sums.
    """
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        (F.col("l_quantity") * P.DD_DOWNLOADS_SCALE).cast("long").alias("downloads"),
        F.col("l_shipdate").cast("string").alias("created_at"))
    li = li.withColumn("weight", decay_column(iso_prefix_date("created_at"), P.DD_AS_OF))
    per_supp = li.groupBy("l_suppkey").agg(F.sum(F.col("downloads") * F.col("weight")).alias("wsum"),
                                           F.count(F.lit(1)).alias("n"))
    supp = (table(spark, sf, "supplier")
            .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", F.concat("n_name", F.lit("/"), "s_name").alias("id")))
    joined = (per_supp.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
                      .withColumn("org", org_of("id", "community"))
                      .filter(~F.col("org").isin(P.DD_EXCLUDED_ORGS)))
    return decayed_sum(joined, "org", "wsum", weight_col=None, count_col="n")


def dd_top(spark, sf):
    top = top_n(dd_orgs(spark, sf), [F.col("downloads").desc(), F.col("org").asc()], P.DD_TOP_N)
    return top.withColumn("display_name", map_lookup("org", P.DD_DISPLAY, F.col("org")))


@query("decayed_downloads", f"""
WITH {_DD_SQL_BASE}
SELECT rank, org, display_name, downloads, model_count, {_SHORT_SQL.format(c='downloads')} AS downloads_label
FROM top""")
def decayed_downloads(spark, sf):
    """Top orgs by recency-decayed downloads, with display name and short text (M8)."""
    return dd_top(spark, sf).select("rank", "org", "display_name", "downloads", "model_count",
                                    short_number("downloads").alias("downloads_label"))


@query("decayed_downloads_kpis", f"""
WITH {_DD_SQL_BASE},
  k AS (SELECT (SELECT sum(downloads) FROM top)::BIGINT AS shown_total, (SELECT count(*) FROM g) AS n_orgs,
               t.org AS top_org, t.display_name AS top_display, t.downloads AS top_downloads, t.model_count AS top_models
        FROM top t WHERE t.rank = 1)
SELECT *, printf({q(fixed.INSIGHT_DOWNLOADS)}, top_display, {_SHORT_SQL.format(c='top_downloads')}, top_models,
                 {_SHORT_SQL.format(c='shown_total')}) AS insight
FROM k""")
def decayed_downloads_kpis(spark, sf):
    """Sum over the shown top-n, org count, leader."""
    orgs = dd_orgs(spark, sf)
    top = dd_top(spark, sf)
    k = top.agg(F.sum("downloads").cast("long").alias("shown_total"))
    # count of whole rows: keeps the sums alive so the branch shares the ranking's exchanges
    n = orgs.agg(F.count(F.struct(*orgs.columns)).alias("n_orgs"))
    lead = top.filter(F.col("rank") == 1).select(F.col("org").alias("top_org"),
                                                 F.col("display_name").alias("top_display"),
                                                 F.col("downloads").alias("top_downloads"),
                                                 F.col("model_count").alias("top_models"))
    return k.crossJoin(n).crossJoin(lead).withColumn("insight", F.format_string(
        fixed.INSIGHT_DOWNLOADS, "top_display", short_number("top_downloads"), "top_models",
        short_number("shown_total")))


# ----------------------------------------------------------------------- M9

_TR_SQL = f"""
  src AS (SELECT o_orderpriority || '/order-' || CAST(o_orderkey AS VARCHAR) AS id,
                 o_custkey AS likes, CAST(trunc(o_totalprice) AS BIGINT) AS downloads,
                 strftime(o_orderdate, '%Y-%m-%d') AS created_date,
                 row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS src_rank
          FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {P.TR_TOP_N}),
  tr AS (SELECT *, 
                CASE WHEN contains(id, '/') THEN substr(id, strpos(id, '/') + 1) ELSE id END AS model_name,
                CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE '—' END AS org,
                date_diff('day', TRY_CAST(created_date AS DATE), DATE '{P.TR_AS_OF}') AS days_ago
         FROM src)"""


def tr_rows(spark, sf):
    """Source top-15 (trending score = total price), rank = source position."""
    o = table(spark, sf, "orders")
    src = top_n(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], P.TR_TOP_N)
    idc = F.concat("o_orderpriority", F.lit("/order-"), F.col("o_orderkey").cast("string"))
    created = F.to_date("o_orderdate").cast("string")
    return src.select(
        "rank",
        short_name(idc).alias("model_name"),
        org_of(idc, "—").alias("org"),
        F.col("o_custkey").alias("likes"),
        F.col("o_totalprice").cast("long").alias("downloads"),
        created.alias("created_date"),
        age_days(iso_prefix_date(created), P.TR_AS_OF).alias("days_ago"),
    )


@query("trending", f"""
WITH {_TR_SQL}
SELECT src_rank AS rank, model_name, org, likes, downloads, created_date, days_ago
FROM tr""")
def trending(spark, sf):
    """Top entries by trending score in source order, with org, short name and age (M9)."""
    return tr_rows(spark, sf)


@query("trending_kpis", f"""
WITH {_TR_SQL},
  r AS (SELECT src_rank AS rank, * FROM tr),
  ld AS (SELECT model_name, rank, org, downloads FROM r ORDER BY downloads DESC, rank LIMIT 1),
  fr AS (SELECT model_name, days_ago FROM r WHERE days_ago IS NOT NULL ORDER BY days_ago, rank LIMIT 1),
  k AS (SELECT (SELECT count(*) FROM r) AS n_models,
               (SELECT model_name FROM ld) AS leader_model, (SELECT rank FROM ld) AS leader_rank,
               (SELECT org FROM ld) AS leader_org, (SELECT downloads FROM ld) AS leader_downloads,
               (SELECT model_name FROM fr) AS freshest_model, (SELECT days_ago FROM fr) AS freshest_days)
SELECT *, printf({q(fixed.INSIGHT_TRENDING)}, leader_rank, leader_model, leader_org,
                 {_SHORT_SQL.format(c='leader_downloads')})
          || CASE WHEN freshest_model IS NOT NULL
                  THEN printf({q(fixed.INSIGHT_TRENDING_FRESHEST)}, freshest_model, freshest_days) ELSE '' END AS insight
FROM k""")
def trending_kpis(spark, sf):
    """Leader by downloads (its rank need not be 1) and freshest model."""
    r = tr_rows(spark, sf)
    lead = F.min(F.struct((-F.col("downloads")).alias("d"), F.col("rank").alias("r"), F.col("model_name").alias("m"),
                          F.col("org").alias("o")))
    fresh = F.min(F.when(F.col("days_ago").isNotNull(),
                         F.struct(F.col("days_ago").alias("a"), F.col("rank").alias("r"), F.col("model_name").alias("m"))))
    one = r.agg(F.count(F.lit(1)).alias("n_models"), lead.alias("l"), fresh.alias("f"))
    one = one.select("n_models", F.col("l.m").alias("leader_model"), F.col("l.r").alias("leader_rank"),
                     F.col("l.o").alias("leader_org"), (-F.col("l.d")).alias("leader_downloads"),
                     F.col("f.m").alias("freshest_model"), F.col("f.a").alias("freshest_days"))
    head = F.format_string(fixed.INSIGHT_TRENDING, "leader_rank", "leader_model", "leader_org",
                           short_number("leader_downloads"))
    tail = F.when(F.col("freshest_model").isNotNull(),
                  F.format_string(fixed.INSIGHT_TRENDING_FRESHEST, "freshest_model", "freshest_days")).otherwise(F.lit(""))
    return one.withColumn("insight", F.concat(head, tail))


# ---------------------------------------------------------------------- M10

_MC_VALUES = ", ".join(f"({q(t)}, {q(lab)})" for t, lab in P.MC_TAGS)


_MC_SQL = f"""
WITH c AS (
  SELECT event_type AS tag, 'user' || CAST(user_id AS VARCHAR) || '/event-' || CAST(event_id AS VARCHAR) AS model_id,
         value AS downloads, user_id AS likes,
         row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
  FROM events)
SELECT c.tag, t.label, c.model_id,
       substr(c.model_id, strpos(c.model_id, '/') + 1) AS model_name,
       split_part(c.model_id, '/', 1) AS org,
       coalesce({case_map("split_part(c.model_id, '/', 1)", P.MC_ORGS)}, split_part(c.model_id, '/', 1)) AS display_org,
       c.downloads, c.likes
FROM c JOIN (VALUES {_MC_VALUES}) AS t(tag, label) ON c.tag = t.tag
WHERE c.rn = 1"""


@query("modality_champions", _MC_SQL)
def modality_champions(spark, sf):
    """Top-1 per tag by downloads; a tag without rows yields no row.

    event_type has a handful of values, so each tag is a hot key: the
    top-1 is cut per map task before the shuffle (partial WindowGroupLimit).
    """
    ev = table(spark, sf, "events").filter(F.col("event_type").isin([t for t, _ in P.MC_TAGS]))
    champ = keep_first(ev, "event_type", [F.col("value").desc(), F.col("event_id").asc()])
    tags = spark.createDataFrame(P.MC_TAGS, "tag string, label string")
    mid = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/event-"), F.col("event_id").cast("string"))
    rows = champ.select(F.col("event_type").alias("tag"), mid.alias("model_id"),
                        F.col("value").alias("downloads"), F.col("user_id").alias("likes"))
    rows = lookup(rows, tags, "tag", "label", how="inner", bounded=True)
    return rows.select("tag", "label", "model_id", short_name("model_id").alias("model_name"),
                       org_of("model_id", "—").alias("org"),
                       map_lookup(org_of("model_id", "—"), P.MC_ORGS, org_of("model_id", "—")).alias("display_org"),
                       "downloads", "likes")


@query("modality_kpis", f"""
WITH ch AS ({_MC_SQL}),
  k AS (SELECT {len(P.MC_TAGS)} AS n_modalities, label, model_name, display_org, downloads
        FROM ch ORDER BY downloads DESC, label LIMIT 1)
SELECT *, printf({q(fixed.INSIGHT_MODALITY)}, n_modalities, display_org, model_name, label,
                 {_SHORT_SQL.format(c='downloads')}) AS insight
FROM k""")
def modality_kpis(spark, sf):
    """The champion with the most downloads over all listed tags."""
    lead = F.min(F.struct((-F.col("downloads")).alias("d"), F.col("label").alias("l"), F.col("model_name").alias("m"),
                          F.col("display_org").alias("o")))
    one = modality_champions(spark, sf).agg(lead.alias("x")).where("x IS NOT NULL").select(
        F.lit(len(P.MC_TAGS)).alias("n_modalities"), F.col("x.l").alias("label"), F.col("x.m").alias("model_name"),
        F.col("x.o").alias("display_org"), (-F.col("x.d")).alias("downloads"))
    # the table's values are fractional: below a thousand the nearest whole number is shown
    shown = F.when(F.col("downloads") >= 1000, short_number("downloads")).otherwise(
        F.bround("downloads", 0).cast("long").cast("string"))
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_MODALITY, "n_modalities", "display_org", "model_name", "label", shown))


# ---------------------------------------------------------------------- M12

@query("package_downloads", f"""
WITH p AS (
  SELECT event_type AS package,
         count(*) FILTER (WHERE ts >= TIMESTAMP '{P.PK_AS_OF}' - INTERVAL 1 DAY) AS last_day,
         count(*) FILTER (WHERE ts >= TIMESTAMP '{P.PK_AS_OF}' - INTERVAL 7 DAY) AS last_week,
         count(*) AS last_month
  FROM events
  WHERE ts >= TIMESTAMP '{P.PK_AS_OF}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{P.PK_AS_OF}'
    AND event_type IN ({sql_list(P.PK_PACKAGES)})
  GROUP BY event_type)
SELECT row_number() OVER (ORDER BY last_week DESC, package) AS rank, package,
       coalesce({case_map('package', P.PK_DISPLAY)}, package) AS display_name,
       last_day, last_week, last_month,
       coalesce({case_map('package', P.PK_COMPANY)}, 'Other') AS company
FROM p""")
def package_downloads(spark, sf):
    """Trailing 1/7/30-day counts per package, display name and company, sorted.

    The 30-day bound is a scan filter (pushed to Parquet); the shorter
    windows are conditional counts in the same partial aggregate.
    """
    as_of = F.lit(P.PK_AS_OF).cast("timestamp_ntz")
    ev = (table(spark, sf, "events")
          .filter((F.col("ts") >= as_of - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") < as_of)
                  & F.col("event_type").isin(P.PK_PACKAGES)))
    p = ev.groupBy(F.col("event_type").alias("package")).agg(
        F.count_if(F.col("ts") >= as_of - F.expr("INTERVAL 1 DAYS")).alias("last_day"),
        F.count_if(F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("last_week"),
        F.count(F.lit(1)).alias("last_month"))
    # One row per listed package at most: the full sort is over a bounded set.
    ranked = top_n(p, [F.col("last_week").desc(), F.col("package").asc()], len(P.PK_PACKAGES))
    return ranked.select("rank", "package", map_lookup("package", P.PK_DISPLAY, F.col("package")).alias("display_name"),
                         "last_day", "last_week", "last_month",
                         map_lookup("package", P.PK_COMPANY, "Other").alias("company"))
