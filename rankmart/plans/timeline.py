"""Timeline marts on the driver tables: M4 release timeline (two sources), flagship
filter, per-org sizes; M11 rule-classified leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import classify_first, clip_lower, strict_date, to_double
from rankmart.operators import append_missing, flagship_cut, impute_median, map_lookup, minmax_scale, salted_join, top_n
from rankmart.plans import params as P
from rankmart.plans.registry import case_map, case_rules, q, query, spark_round
from rankmart.session import checkpoint_dir
from rankmart.sources import table

# ------------------------------------------------------------- M4 sources


def last_orders(spark, sf):
    """Customers with orders and the time of the last one; orders are one row per customer key before the join."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"))
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return last.join(cust, F.col("o_custkey") == F.col("c_custkey"))


def last_seen(spark, sf, seen=None):
    """Benchmark-style entities: last date per name, org by prefix rule, unmatched dropped."""
    rows = (last_orders(spark, sf) if seen is None else seen).withColumn("org", classify_first("c_mktsegment", P.TL_PREFIX_RULES, "prefix"))
    return (rows.filter(F.col("org").isNotNull())
                .select(F.col("c_name").alias("model_group"),
                        strict_date(F.to_date("last_date").cast("string")).alias("date"), "org")
                .filter(F.col("date").isNotNull()))


_LS_SQL = f"""
  ls AS (SELECT c.c_name AS model_group, CAST(max(o.o_orderdate) AS DATE) AS date,
                {case_rules('c.c_mktsegment', P.TL_PREFIX_RULES, 'prefix')} AS org
         FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
         GROUP BY c.c_custkey, c.c_name, c.c_mktsegment)"""


@query("entity_last_seen", f"""
WITH {_LS_SQL}
SELECT model_group, date, org FROM ls WHERE org IS NOT NULL AND date IS NOT NULL""")
def entity_last_seen(spark, sf):
    """Last date per entity with its prefix-rule org; unmatched orgs dropped."""
    return last_seen(spark, sf)


def notable(spark, sf):
    """Catalogue-style rows: parsed date from 2020-like bound, mapped org (inner), numeric
    columns from text with unparsable -> null (S2 N3 F9 J4 F12 F13)."""
    # the bound stands on the raw column, so it reaches the scan; a date at or after it is one whose day is
    o = (table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit(P.TL_MIN_DATE).cast("timestamp_ntz"))
         .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    c = (table(spark, sf, "customer").withColumn("org", map_lookup("c_mktsegment", P.TL_ORG_MAP))
         .filter(F.col("org").isNotNull()).select("c_custkey", "c_name", "org"))
    # one row per order is needed here (no pre-aggregation possible), so a customer
    # holding a large share of the orders is spread over several tasks
    rows = salted_join(o, c, "o_custkey", "c_custkey", salt_by=["o_orderkey"]).select(
        F.col("c_name").alias("model"), "org",
        strict_date(F.to_date("o_orderdate").cast("string")).alias("date"),
        to_double(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string"))
                   .otherwise(F.lit("unknown"))).alias("compute_flop"),
        to_double(F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_totalprice") / 1000).cast("string"))
                   .otherwise(F.lit(""))).alias("parameters"))
    return rows.filter(F.col("date").isNotNull()).withColumn("has_compute", F.col("compute_flop").isNotNull())


def timeline(spark, sf):
    """A plus the B names absent from A (case/space-insensitive), B without compute."""
    a = notable(spark, sf)
    seen = last_orders(spark, sf)
    # a customer is in A if the last order is late enough: its names come from the rows per customer, not from A's join
    names = (seen.filter((F.col("last_date") >= F.lit(P.TL_MIN_DATE).cast("timestamp_ntz")) & map_lookup("c_mktsegment", P.TL_ORG_MAP).isNotNull())
                 .select(F.col("c_name").alias("model")))
    b = (last_seen(spark, sf, seen)
         .select(F.col("model_group").alias("model"), "org", "date",
                 F.lit(None).cast("double").alias("compute_flop"),
                 F.lit(None).cast("double").alias("parameters"),
                 F.lit(False).alias("has_compute")))
    return append_missing(a, b, "model", "model", names=names)


_TL_SQL = _LS_SQL + f""",
  a AS (SELECT c.c_name AS model, {case_map('c.c_mktsegment', P.TL_ORG_MAP)} AS org,
               CAST(o.o_orderdate AS DATE) AS date,
               CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice END AS compute_flop,
               CASE WHEN o.o_orderpriority <> '5-LOW' THEN o.o_totalprice / 1000 END AS parameters
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
  a2 AS (SELECT *, compute_flop IS NOT NULL AS has_compute FROM a
         WHERE date >= DATE '{P.TL_MIN_DATE}' AND org IS NOT NULL),
  b AS (SELECT model_group AS model, org, date, CAST(NULL AS DOUBLE) AS compute_flop,
               CAST(NULL AS DOUBLE) AS parameters, false AS has_compute
        FROM ls WHERE org IS NOT NULL AND date IS NOT NULL
          AND lower(regexp_replace(model_group, '^\\s+|\\s+$', '', 'g')) NOT IN
              (SELECT lower(regexp_replace(model, '^\\s+|\\s+$', '', 'g')) FROM a2 WHERE model IS NOT NULL)),
  tl AS (SELECT * FROM a2 UNION ALL SELECT * FROM b)"""


@query("release_timeline", f"""
WITH {_TL_SQL}
SELECT model, org, date, compute_flop, parameters, has_compute FROM tl""")
def release_timeline(spark, sf):
    """Catalogue rows plus the entities missing from them by normalised name (M4 union)."""
    return timeline(spark, sf).select("model", "org", "date", "compute_flop", "parameters", "has_compute")


@query("release_timeline_kpis", f"""
WITH {_TL_SQL},
  oc AS (SELECT org, count(*) AS n FROM tl WHERE org IS NOT NULL GROUP BY org ORDER BY n DESC, org LIMIT 1),
  big AS (SELECT model, org, compute_flop FROM tl WHERE has_compute
          ORDER BY compute_flop DESC, model, date LIMIT 1),
  k AS (SELECT (SELECT count(*) FROM tl) AS n_rows,
       (SELECT count(*) FROM tl WHERE has_compute) AS n_with_compute,
       (SELECT org FROM oc) AS most_active_org, (SELECT n FROM oc) AS most_active_count,
       (SELECT model FROM big) AS biggest_model, (SELECT org FROM big) AS biggest_org,
       (SELECT compute_flop FROM big) AS biggest_compute,
       round((SELECT min(compute_flop) FROM tl WHERE has_compute) * 0.15, 6) AS rug_level)
SELECT *, CASE WHEN biggest_model IS NULL THEN printf({q(fixed.INSIGHT_TIMELINE_NO_COMPUTE)}, most_active_org, most_active_count)
               ELSE printf({q(fixed.INSIGHT_TIMELINE)}, most_active_org, most_active_count, biggest_model, biggest_org,
                           biggest_compute) END AS insight
FROM k""")
def release_timeline_kpis(spark, sf):
    """Most active org over the whole union, largest run, rug level."""
    tl = timeline(spark, sf)
    # One partial aggregate per org carries every statistic; the global answer is
    # a reduction of that small per-org table (one pass over the union).
    big = F.min(F.when(F.col("has_compute"), F.struct((-F.col("compute_flop")).alias("c"), F.col("model").alias("m"),
                                                      F.col("date").alias("d"), F.col("org").alias("o"))))
    per_org = tl.groupBy("org").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_compute").alias("nc"),
                                    big.alias("b"), F.min(F.when(F.col("has_compute"), F.col("compute_flop"))).alias("mn"))
    one = per_org.agg(
        F.sum("n").alias("n_rows"), F.sum("nc").alias("n_with_compute"), F.min("b").alias("b"), F.min("mn").alias("mn"),
        F.min(F.when(F.col("org").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("org").alias("o")))).alias("m"))
    one = one.select(
        "n_rows", "n_with_compute", F.col("m.o").alias("most_active_org"), (-F.col("m.k")).alias("most_active_count"),
        F.col("b.m").alias("biggest_model"), F.col("b.o").alias("biggest_org"), (-F.col("b.c")).alias("biggest_compute"),
        F.round(F.col("mn") * 0.15, 6).alias("rug_level"))
    with_compute = F.format_string(fixed.INSIGHT_TIMELINE, "most_active_org", "most_active_count", "biggest_model",
                                   "biggest_org", "biggest_compute")
    no_compute = F.format_string(fixed.INSIGHT_TIMELINE_NO_COMPUTE, "most_active_org", "most_active_count")
    return one.withColumn("insight", F.when(F.col("biggest_model").isNotNull(), with_compute).otherwise(no_compute))


@query("timeline_series", f"""
WITH {_TL_SQL}
SELECT org || CASE WHEN has_compute THEN '' ELSE ' (awaiting compute)' END AS series, org, has_compute, count(*) AS n,
       min(date) AS first_date, max(date) AS last_date, max(compute_flop) AS largest
FROM tl GROUP BY org, has_compute""")
def timeline_series(spark, sf):
    """One plan for all series of the timeline: the series is a column that a chart filters on (F16)."""
    tl = timeline(spark, sf)
    label = F.concat("org", F.when(F.col("has_compute"), "").otherwise(" (awaiting compute)")).alias("series")
    return (tl.groupBy("org", "has_compute").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                                 F.max("compute_flop").alias("largest"))
              .select(label, "org", "has_compute", "n", "first_date", "last_date", "largest"))


@query("group_median_impute", f"""
WITH {_TL_SQL},
  c AS (SELECT model, org, date, compute_flop, CASE WHEN parameters IS NOT NULL THEN greatest(parameters, 1.0) END AS p
        FROM tl WHERE has_compute),
  m AS (SELECT org, median(p) AS med FROM c GROUP BY org),
  l AS (SELECT c.*, log10(coalesce(c.p, m.med)) AS lg FROM c JOIN m USING (org)),
  bd AS (SELECT org, min(lg) AS mn, max(lg) AS mx FROM l GROUP BY org)
SELECT model, org, date, compute_flop, round(p, 6) AS parameters,
       round(CASE WHEN mx > mn THEN 6.0 + (lg - mn) / (mx - mn) * 16.0 ELSE {P.TL_FALLBACK_SIZE} END, 6) AS size
FROM l JOIN bd USING (org)""")
def group_median_impute(spark, sf):
    """Dot sizes of the rows with compute: per org, clip at 1, fill with the org median,
    log10, min-max to 6-22, 12 when the org has no spread (A21 W9 W10 X16 X17 X18)."""
    # The median, its join back and the per-org bounds all read these rows: write
    # them once to the shared checkpoint folder instead of re-deriving the
    # two-source union in every branch (and to cut the lineage for retries).
    checkpoint_dir(spark)
    c = (timeline(spark, sf).filter("has_compute")
         .select("model", "org", "date", "compute_flop",
                 clip_lower("parameters", 1.0).alias("p"))
         .checkpoint())
    filled = impute_median(c, "p", "org", "p_filled")
    logged = filled.withColumn("lg", F.log10("p_filled"))
    sized = minmax_scale(logged, "lg", 6.0, 22.0, P.TL_FALLBACK_SIZE, "size", by="org")
    return sized.select("model", "org", "date", "compute_flop", F.round("p", 6).alias("parameters"),
                        F.round("size", 6).alias("size"))


# ------------------------------------------------------------ flagship filter

def _fl_model():
    adj = F.split("p_name", " ").getItem(0)
    noun = F.split("p_name", " ").getItem(1)
    return F.concat_ws(" ", F.col("p_brand"), F.initcap(noun), F.initcap(adj))


def _fl_strip_sql(col: str) -> str:
    out = col
    for p in P.FL_STRIP:
        out = f"regexp_replace({out}, '{p}', '')"
    return out


_FL_TIER_SQL = "(CASE " + " ".join(f"WHEN contains(model, '{k}') THEN {v}" for k, v in P.FL_TIERS) + " ELSE 2 END)"


@query("flagship_variant", f"""
WITH d AS (SELECT l_partkey, CAST(max(l_shipdate) AS DATE) AS date FROM lineitem GROUP BY l_partkey),
  m AS (SELECT p.p_partkey, concat_ws(' ', p.p_brand,
                 upper(substr(split_part(p.p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p.p_name, ' ', 2), 2)),
                 upper(substr(split_part(p.p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p.p_name, ' ', 1), 2))) AS model,
               d.date
        FROM part p JOIN d ON d.l_partkey = p.p_partkey
        WHERE d.date >= DATE '{P.FL_AS_OF}' - INTERVAL {P.FL_MONTHS} MONTH),
  f AS (SELECT *, {_fl_strip_sql('model')} AS family, {_FL_TIER_SQL} AS tier FROM m)
SELECT family, model, p_partkey, date, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY tier DESC, date DESC, model, p_partkey) AS rn FROM f)
WHERE rn = 1""")
def flagship_variant(spark, sf):
    """Recent rows only (calendar months before as_of), family by ordered suffix strip,
    highest tier then newest per family (F8 X6 X7 W3 O8)."""
    last = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").cast("date").alias("date"))
    rows = (table(spark, sf, "part").join(last, F.col("l_partkey") == F.col("p_partkey"))
            .select("p_partkey", _fl_model().alias("model"), "date"))
    kept = flagship_cut(rows, P.FL_AS_OF, P.FL_MONTHS, P.FL_STRIP, P.FL_TIERS, 2,
                        tiebreak=[F.col("model").asc(), F.col("p_partkey").asc()])
    return kept.select(F.col("_family").alias("family"), "model", "p_partkey", "date", F.col("_tier").alias("tier"))


# ---------------------------------------------------------------------- M11

_RL_SQL = f"""
  r AS (SELECT p_partkey AS src_pos, p_name || ' ' || p_brand AS name, coalesce(p_retailprice, 0.0) AS resolved,
               coalesce(p_size > 40, false) OR coalesce(p_type = 'PROMO', false) AS is_open
        FROM part ORDER BY resolved DESC, src_pos LIMIT {P.RL_TOP_N}),
  rl AS (SELECT row_number() OVER (ORDER BY resolved DESC, src_pos) AS rank, name, resolved,
                {case_rules('name', P.RL_RULES, 'contains_ci', "'Other'")} AS org, is_open FROM r)"""


def rl_rows(spark, sf):
    """Top entries by score (missing = 0) in source order on ties, org by ordered
    case-insensitive rules, open flag from two nullable booleans (O5 X8 X25)."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("src_pos"),
        F.concat_ws(" ", "p_name", "p_brand").alias("name"),
        F.coalesce("p_retailprice", F.lit(0.0)).alias("resolved"),
        (F.coalesce(F.col("p_size") > 40, F.lit(False)) | F.coalesce(F.col("p_type") == "PROMO", F.lit(False))).alias("is_open"))
    top = top_n(p, [F.col("resolved").desc(), F.col("src_pos").asc()], P.RL_TOP_N)
    return top.select("rank", "name", "resolved",
                      classify_first("name", P.RL_RULES, "contains_ci", "Other").alias("org"), "is_open")


@query("rule_leaderboard", f"""
WITH {_RL_SQL}
SELECT rank, name, resolved, org, is_open FROM rl""")
def rule_leaderboard(spark, sf):
    """Top entries by score with org from ordered case-insensitive rules and an open flag."""
    return rl_rows(spark, sf)


@query("rule_leaderboard_kpis", f"""
WITH {_RL_SQL},
  k AS (SELECT (SELECT count(*) FILTER (WHERE is_open) FROM rl) AS n_open, (SELECT count(*) FROM rl) AS n_shown,
               (SELECT count(DISTINCT org) FROM rl) AS n_orgs, name AS top_name, org AS top_org,
               resolved AS top_resolved
        FROM rl WHERE rank = 1)
SELECT *, printf({q(fixed.INSIGHT_CODING)}, top_name, {spark_round('top_resolved', 1)}, n_open, n_shown) AS insight
FROM k""")
def rule_leaderboard_kpis(spark, sf):
    """Open entries among the shown ones and the leader."""
    rl = rl_rows(spark, sf)
    k = rl.agg(F.count_if("is_open").alias("n_open"), F.count(F.lit(1)).alias("n_shown"),
               F.count_distinct("org").alias("n_orgs"))
    lead = rl.filter(F.col("rank") == 1).select(F.col("name").alias("top_name"), F.col("org").alias("top_org"),
                                                F.col("resolved").alias("top_resolved"))
    return k.crossJoin(lead).withColumn("insight", F.format_string(
        fixed.INSIGHT_CODING, "top_name", F.round("top_resolved", 1), "n_open", "n_shown"))
