"""Catalog marts on the driver tables: M3 price map, M2 context sizes, M5 capabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import family_key_dated, family_key_tagged, org_of, short_tokens, to_double
from rankmart.operators import bucket_counts, bucketize, capability_counts, keep_first, log_minmax, map_lookup
from rankmart.operators.capability import modality_count
from rankmart.operators.dedup import first_by_aggregate, number_duplicates
from rankmart.plans import params as P
from rankmart.plans.registry import case_map, q, query, spark_round, sql_list
from rankmart.sources import table

# ----------------------------------------------------------------------- M3

_PR_SQL = f"""
  li AS (SELECT lower(replace(p.p_brand, 'Brand#', 'brand')) AS org,
                lower(replace(p.p_brand, 'Brand#', 'brand')) || '/' || replace(p.p_name, ' ', '-') || '-'
                  || strftime(l.l_shipdate, '%Y-%m-%d') AS id,
                l.l_extendedprice * l.l_discount / 1e8 * 1e6 AS prompt_1m,
                l.l_extendedprice * l.l_tax / 1e8 * 1e6 AS completion_1m,
                CAST(epoch(l.l_shipdate) AS BIGINT) AS created,
                CAST(l.l_quantity * 1000 AS BIGINT) AS context_length, l.l_orderkey, l.l_linenumber
         FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
  f AS (SELECT *, regexp_replace(regexp_replace(id, '(-\\d{{4}})?-\\d{{2}}-\\d{{2}}$', ''), '-\\d{{4}}-\\d{{2}}$', '') AS family
        FROM li
        WHERE org IN ({sql_list(P.PR_ORGS)}) AND prompt_1m > 0 AND completion_1m > 0
          AND prompt_1m <= {fixed.PRICE_CAP_PER_1M} AND completion_1m <= {fixed.PRICE_CAP_PER_1M}
          AND created >= CAST(epoch(TIMESTAMP '{P.PR_AS_OF}') AS BIGINT) - {fixed.PRICE_MAX_AGE_SECONDS}),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY created DESC, id, l_orderkey, l_linenumber) AS rn FROM f) WHERE rn = 1),
  b AS (SELECT min(log10(greatest(context_length, 1))) AS mn, max(log10(greatest(context_length, 1))) AS mx FROM k),
  pr AS (SELECT family, id AS name, org,
                {spark_round('prompt_1m', 3)} AS prompt_1m,
                {spark_round('completion_1m', 3)} AS completion_1m,
                context_length,
                round(CASE WHEN mx > mn THEN 5.0 + (log10(greatest(context_length, 1)) - mn) / (mx - mn) * 23.0 ELSE 16.5 END, 6) AS dot_size
         FROM k, b)"""


def price_rows(spark, sf):
    """Newest variant per family among allowed orgs, priced, recent.

    Filters run before the join (brand list on part; price and age on the
    lineitem scan, the date bound pushed into Parquet); the newest-per-family
    cut is a row_number limit applied map-side too, so a family holding a
    large share of rows is reduced before its shuffle.
    """
    as_of_epoch = F.unix_seconds(F.lit(P.PR_AS_OF).cast("timestamp"))
    part = (table(spark, sf, "part")
            .withColumn("org", F.lower(F.regexp_replace("p_brand", "Brand#", "brand")))
            .filter(F.col("org").isin(P.PR_ORGS))
            .select("p_partkey", "p_name", "org"))
    li = (table(spark, sf, "lineitem")
          .filter(F.col("l_shipdate") >= (F.lit(P.PR_AS_OF).cast("timestamp_ntz")
                                          - F.expr(f"INTERVAL {fixed.PRICE_MAX_AGE_SECONDS} SECONDS")))
          .select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate",
                  to_double((F.col("l_extendedprice") * F.col("l_discount") / 1e8).cast("string")).alias("p_raw"),
                  to_double((F.col("l_extendedprice") * F.col("l_tax") / 1e8).cast("string")).alias("c_raw"),
                  (F.col("l_quantity") * 1000).cast("long").alias("context_length"))
          .filter((F.col("p_raw") > 0) & (F.col("c_raw") > 0))
          .withColumns({"prompt_1m": F.col("p_raw") * 1e6, "completion_1m": F.col("c_raw") * 1e6})
          .filter((F.col("prompt_1m") <= fixed.PRICE_CAP_PER_1M) & (F.col("completion_1m") <= fixed.PRICE_CAP_PER_1M)))
    # Newest line per part first: the family order (created, id, line keys) is,
    # within one part, (created, line keys), so this cut keeps every possible
    # winner while the join shuffles one row per part instead of every line.
    li = keep_first(li.withColumn("_c", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))), "l_partkey",
                    [F.col("_c").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]).drop("_c")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    idc = F.concat("org", F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("-"),
                   F.to_date("l_shipdate").cast("string"))
    rows = (rows.withColumn("id", idc)
                .withColumns({"org": org_of("id"), "family": family_key_dated("id"),
                              "created": F.unix_seconds(F.col("l_shipdate").cast("timestamp"))})
                .filter(F.col("created") >= as_of_epoch - fixed.PRICE_MAX_AGE_SECONDS))
    kept = keep_first(rows, "family", [F.col("created").desc(), F.col("id").asc(),
                                       F.col("l_orderkey").asc(), F.col("l_linenumber").asc()])
    # the analog rows have no display name, so the name falls back to the id (as in the source)
    kept = kept.select("family", F.col("id").alias("name"), "org",
                       F.round("prompt_1m", 3).alias("prompt_1m"), F.round("completion_1m", 3).alias("completion_1m"),
                       "context_length")
    return log_minmax(kept, "context_length", 5.0, 28.0, 16.5, "dot_size") \
        .withColumn("dot_size", F.round("dot_size", 6))


@query("price_latest_family", f"""
WITH {_PR_SQL}
SELECT * FROM pr""")
def price_latest_family(spark, sf):
    """Newest priced variant per family among allowed orgs, with dot size (M3)."""
    return price_rows(spark, sf)


@query("price_latest_family_kpis", f"""
WITH {_PR_SQL},
  c AS (SELECT (SELECT count(*) FROM pr) AS n_models, (SELECT count(DISTINCT org) FROM pr) AS n_orgs,
               name AS cheapest_name, org AS cheapest_org,
               {spark_round('prompt_1m + completion_1m', 3)} AS cheapest_total,
               prompt_1m AS p, completion_1m AS cp
        FROM pr ORDER BY prompt_1m + completion_1m, name LIMIT 1)
SELECT n_models, n_orgs, cheapest_name, cheapest_org, cheapest_total,
       printf({q(fixed.INSIGHT_PRICING)}, n_models, cheapest_name, {spark_round('p', 2)}, {spark_round('cp', 2)}) AS insight
FROM c""")
def price_latest_family_kpis(spark, sf):
    """Cheapest model by prompt + completion price."""
    pr = price_rows(spark, sf)
    tot = F.col("prompt_1m") + F.col("completion_1m")
    cheap = F.min(F.struct(tot.alias("t"), F.col("name").alias("n"), F.col("org").alias("o"),
                           F.col("prompt_1m").alias("p"), F.col("completion_1m").alias("c")))
    one = pr.agg(F.count(F.lit(1)).alias("n_models"), F.count_distinct("org").alias("n_orgs"), cheap.alias("c"))
    return one.select("n_models", "n_orgs", F.col("c.n").alias("cheapest_name"), F.col("c.o").alias("cheapest_org"),
                      F.round("c.t", 3).alias("cheapest_total"),
                      F.format_string(fixed.INSIGHT_PRICING, "n_models", F.col("c.n"), F.round("c.p", 2),
                                      F.round("c.c", 2)).alias("insight"))


# ----------------------------------------------------------------------- M2

_CTX_ID_SQL = """source || '/' || lang || (CASE doc_id % 4 WHEN 0 THEN ''
      WHEN 1 THEN '-2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
      WHEN 2 THEN ':free'
      ELSE '-2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || ':extended' END)"""
_TAGS = "|".join(fixed.CONTEXT_VARIANT_TAGS)
_CTX_SQL = f"""
  d AS (SELECT doc_id AS src_pos, {_CTX_ID_SQL} AS id, 'doc-' || CAST(doc_id AS VARCHAR) AS name,
               coalesce(n_chars, 0) AS ctx FROM documents),
  f AS (SELECT *, (CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE '' END) AS org,
               (CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE '' END) || '/' ||
               regexp_replace(regexp_replace(regexp_extract(id, '([^/]*)$', 1), '-\\d{{4}}-\\d{{2}}(-\\d{{2}})?$', ''),
                              ':({_TAGS})$', '') AS family_key
        FROM d WHERE id NOT IN ({sql_list(P.CTX_EXCLUDE_IDS)}) AND ctx > 0),
  fam AS (SELECT family_key, id, name, ctx, org, first_pos FROM (
            SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY ctx DESC, src_pos) AS rn,
                   min(src_pos) OVER (PARTITION BY family_key) AS first_pos FROM f) WHERE rn = 1)"""


def context_families(spark, sf):
    """Largest variant per family, first seen on ties, plus the family's first source position
    (S5 F4 F5 X1 X3 X5 W4). One partial aggregate: each map task keeps one row per family."""
    d = table(spark, sf, "documents")
    m = F.lpad(((F.col("doc_id") % 12) + 1).cast("string"), 2, "0")
    dd = F.lpad(((F.col("doc_id") % 28) + 1).cast("string"), 2, "0")
    suffix = (F.when(F.col("doc_id") % 4 == 0, F.lit(""))
               .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("-2024-"), m, F.lit("-"), dd))
               .when(F.col("doc_id") % 4 == 2, F.lit(":free"))
               .otherwise(F.concat(F.lit("-2024-"), m, F.lit(":extended"))))
    rows = (d.select(F.col("doc_id").alias("src_pos"),
                     F.concat("source", F.lit("/"), "lang", suffix).alias("id"),
                     F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
                     F.coalesce("n_chars", F.lit(0)).alias("ctx"))
             .filter(~F.col("id").isin(P.CTX_EXCLUDE_IDS) & (F.col("ctx") > 0))
             .withColumn("family_key", family_key_tagged("id", fixed.CONTEXT_VARIANT_TAGS))
             .withColumn("org", org_of("id", "")))
    return first_by_aggregate(rows, "family_key", [-F.col("ctx"), F.col("src_pos")],
                              ["id", "name", "ctx", "org"], extra=[F.min("src_pos").alias("first_pos")])


@query("context_family_max", f"""
WITH {_CTX_SQL}
SELECT family_key, id, name, ctx, org, first_pos FROM fam""")
def context_family_max(spark, sf):
    """Largest-context variant per family, first seen on ties, with the family's first position (M2)."""
    return context_families(spark, sf).select("family_key", "id", "name", "ctx", "org", "first_pos")


def _bucket_sql():
    whens = []
    for i, (_, lo, hi) in enumerate(fixed.CONTEXT_BUCKETS, start=1):
        cond = f"ctx >= {lo}" if hi is None else f"ctx BETWEEN {lo} AND {hi}"
        whens.append(f"WHEN {cond} THEN {i}")
    return f"(CASE {' '.join(whens)} END)"


_SWEET_SPOT = [lab for lab, _, _ in fixed.CONTEXT_BUCKETS].index("32–128K") + 1
_BUCKET_DIM = ", ".join(f"({i}, {q(lab)})" for i, (lab, _, _) in enumerate(fixed.CONTEXT_BUCKETS, start=1))


@query("size_buckets", f"""
WITH {_CTX_SQL},
  lab AS (SELECT *, {_bucket_sql()} AS ord FROM fam),
  c AS (SELECT ord, count(*) AS n FROM lab WHERE ord IS NOT NULL GROUP BY ord),
  e AS (SELECT ord, string_agg(name, ', ' ORDER BY rn) AS ex FROM (
          SELECT ord, name, row_number() OVER (PARTITION BY ord ORDER BY ctx DESC, first_pos) AS rn
          FROM lab WHERE ord IS NOT NULL) WHERE rn <= {fixed.BUCKET_EXAMPLES} GROUP BY ord)
SELECT dim.ord, dim.bucket, coalesce(c.n, 0) AS count, coalesce(e.ex, '—') AS examples
FROM (VALUES {_BUCKET_DIM}) AS dim(ord, bucket) LEFT JOIN c USING (ord) LEFT JOIN e USING (ord)""")
def size_buckets(spark, sf):
    """Families per inclusive size bucket, empty buckets kept, top-3 names."""
    fam = context_families(spark, sf)
    return bucket_counts(spark, fam, "ctx", "name", fixed.CONTEXT_BUCKETS, F.col("first_pos").asc(),
                         examples=fixed.BUCKET_EXAMPLES, none_text=fixed.NO_EXAMPLES)


@query("context_kpis", f"""
WITH {_CTX_SQL},
  k AS (SELECT (SELECT count(*) FROM fam) AS total_unique,
               (SELECT count(*) FROM fam WHERE {_bucket_sql()} = {_SWEET_SPOT}) AS sweet_spot,
               (SELECT count(*) FROM fam WHERE {_bucket_sql()} = {len(fixed.CONTEXT_BUCKETS)}) AS over_1m,
               name AS max_name, ctx AS max_ctx
        FROM fam ORDER BY ctx DESC, first_pos LIMIT 1)
SELECT *, printf({q(fixed.INSIGHT_CONTEXT)}, total_unique, sweet_spot, over_1m, max_name,
                 CASE WHEN max_ctx >= 1000000 THEN printf('%.1fM', {spark_round('max_ctx / 1000000.0', 1)})
                      ELSE printf('%dK', max_ctx // 1000) END) AS insight
FROM k""")
def context_kpis(spark, sf):
    """Unique families, the sweet-spot and over-1M bucket counts, the largest family."""
    fam = context_families(spark, sf).withColumn("ord", bucketize("ctx", fixed.CONTEXT_BUCKETS))
    top = F.min(F.struct((-F.col("ctx")).alias("c"), F.col("first_pos").alias("p"), F.col("name").alias("n")))
    one = fam.agg(F.count(F.lit(1)).alias("total_unique"), F.count_if(F.col("ord") == _SWEET_SPOT).alias("sweet_spot"),
                  F.count_if(F.col("ord") == len(fixed.CONTEXT_BUCKETS)).alias("over_1m"), top.alias("t"))
    one = one.where("t IS NOT NULL").select("total_unique", "sweet_spot", "over_1m", F.col("t.n").alias("max_name"),
                                            (-F.col("t.c")).alias("max_ctx"))
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_CONTEXT, "total_unique", "sweet_spot", "over_1m", "max_name", short_tokens("max_ctx")))


# ----------------------------------------------------------------------- M5

_CAP_COLS = ", ".join(
    f"""sum(CASE WHEN list_contains({'inputs' if side == 'input' else 'outputs'}, {q(val)}) THEN 1 ELSE 0 END)::BIGINT AS "{name}\""""
    for name, side, val in P.CAP_SPEC)


@query("capability_matrix", f"""
WITH v AS (
  SELECT 'org' || CAST(user_id % {P.CAP_ORGS_N} AS VARCHAR) || '/u' || CAST(user_id AS VARCHAR) || '-'
           || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS id,
         CAST(ts AS DATE) AS day,
         list_sort(list_distinct(list(event_type) FILTER (WHERE value < {P.CAP_SPLIT}))) AS inputs,
         list_sort(list_distinct(list(event_type) FILTER (WHERE value >= {P.CAP_SPLIT}))) AS outputs
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
  f AS (SELECT *, regexp_replace(regexp_replace(id, '(-\\d{{4}})?-\\d{{2}}-\\d{{2}}$', ''), '-\\d{{4}}-\\d{{2}}$', '') AS family,
               coalesce(len(inputs), 0) + coalesce(len(outputs), 0) AS n_mod FROM v),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n_mod DESC, day) AS rn FROM f) WHERE rn = 1),
  g AS (SELECT CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE id END AS org, count(*) AS total_models,
               {_CAP_COLS}
        FROM k GROUP BY 1)
SELECT row_number() OVER (ORDER BY total_models DESC, org) AS rank, org,
       coalesce({case_map('org', P.CAP_ORG_NAMES)}, org) AS display_name, * EXCLUDE (org)
FROM g ORDER BY total_models DESC, org LIMIT {P.CAP_TOP_N}""")
def capability_matrix(spark, sf):
    """Families per org with each capability, top orgs.

    Variants are (user, day) with their modality sets (bounded by the
    number of event types); the most capable variant per family wins,
    earliest first on ties.
    """
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    v = ev.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_set(F.when(F.col("value") < P.CAP_SPLIT, F.col("event_type")))).alias("inputs"),
        F.array_sort(F.collect_set(F.when(F.col("value") >= P.CAP_SPLIT, F.col("event_type")))).alias("outputs"))
    v = v.withColumn("id", F.concat(F.lit("org"), (F.col("user_id") % P.CAP_ORGS_N).cast("string"),
                                    F.lit("/u"), F.col("user_id").cast("string"), F.lit("-"),
                                    F.col("day").cast("string")))
    v = v.withColumn("family", family_key_dated("id")).withColumn("n_mod", modality_count("inputs", "outputs"))
    kept = keep_first(v, "family", [F.col("n_mod").desc(), F.col("day").asc()])
    kept = kept.withColumn("org", org_of("id"))
    caps = capability_counts(kept, "org", "inputs", "outputs", P.CAP_SPEC, P.CAP_TOP_N)
    names = [name for name, _, _ in P.CAP_SPEC]
    return caps.select("rank", "org", map_lookup("org", P.CAP_ORG_NAMES, F.col("org")).alias("display_name"),
                       "total_models", *[F.col(f"`{n}`") for n in names])


# ------------------------------------------------------ duplicate ranks (X19 key)

@query("duplicate_rank", """
SELECT md5(text) AS text_md5, lang,
       row_number() OVER (PARTITION BY md5(text), lang) AS dup_rank
FROM documents""")
def duplicate_rank(spark, sf):
    """Rank of each row among identical rows (the jitter key for rows with no id).

    Whole texts are hashed; identical (text, language) rows get ranks 1..n by
    counting, chunking and regenerating (``number_duplicates``), so one text
    copied a million times is spread over many tasks.
    """
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "lang")
    return number_duplicates(d, "dup_rank")
