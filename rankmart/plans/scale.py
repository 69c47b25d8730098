"""Operators of any size as queries: rule tables (X7-X9), interval tables (J9), mergeable sketches (A2, A9, A20), freshness
by timers (T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart.operators.intervals import interval_counts
from rankmart.operators.rules import classify_table
from rankmart.operators.sketches import distinct_over, distinct_sketches, heavy_hitters, relative_error
from rankmart.plans import params as P
from rankmart.plans.landing import scratch
from rankmart.plans.registry import case_map, query, sql_list
from rankmart.sources import table
from rankmart.streaming.freshness import start_freshness

# ------------------------------------------------------------------ rule tables


def rule_table(spark, n: int):
    """n substring rules over part names, brands and types: pieces of the phrase that each number spells."""
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.expr(f"id div {k}") % len(xs) + 1).cast("int"))
    phrase = F.concat_ws(" ", pick(P.RT_ADJECTIVES, 1), pick(P.RT_NOUNS, 8), F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")), pick(P.RT_TYPES, 3))
    piece = phrase.substr((F.col("id") % 23 + 1).cast("int"), (F.col("id") * 7 % 11 + 2).cast("int"))
    return spark.range(n).select(F.col("id").alias("rule"), F.trim(piece).alias("pattern"), F.concat(F.lit("group "), (F.col("id") % 97).cast("string")).alias("label")) \
        .withColumn("rule", F.col("rule") * 7919 % n)


_PICK = lambda xs, k: f"([{sql_list(xs)}])[CAST(id // {k} % {len(xs)} + 1 AS INTEGER)]"
_RULES_SQL = f"""
  raw AS (SELECT id, concat_ws(' ', {_PICK(P.RT_ADJECTIVES, 1)}, {_PICK(P.RT_NOUNS, 8)}, 'Brand#' || CAST(id % 25 + 1 AS VARCHAR), {_PICK(P.RT_TYPES, 3)}) AS phrase
          FROM range({P.RT_RULES}) AS r(id)),
  rules AS (SELECT id * 7919 % {P.RT_RULES} AS rule, trim(substr(phrase, id % 23 + 1, id * 7 % 11 + 2)) AS pattern, 'group ' || CAST(id % 97 AS VARCHAR) AS label FROM raw),
  texts AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part)"""


@query("rule_table", f"""
WITH {_RULES_SQL},
  best AS (SELECT text, min_by(label, rule) AS label FROM (SELECT DISTINCT text FROM texts) t JOIN rules ON contains(t.text, rules.pattern) GROUP BY text)
SELECT p_partkey, coalesce(label, 'Other') AS label FROM texts LEFT JOIN best USING (text)""")
def rule_table_labels(spark, sf):
    """5,000 ordered substring rules as a table: the first that a part's name, brand and type hold."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return classify_table(parts, "text", rule_table(spark, P.RT_RULES), "contains", "Other").select("p_partkey", "label")


@query("prefix_rule_table", f"""
WITH {_RULES_SQL},
  best AS (SELECT text, min_by(label, rule) AS label FROM (SELECT DISTINCT text FROM texts) t JOIN rules ON starts_with(t.text, rules.pattern) GROUP BY text)
SELECT p_partkey, coalesce(label, 'Other') AS label FROM texts LEFT JOIN best USING (text)""")
def prefix_rule_table(spark, sf):
    """The same rules as prefixes."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return classify_table(parts, "text", rule_table(spark, P.RT_RULES), "prefix", "Other").select("p_partkey", "label")


# ------------------------------------------------------------------ interval tables


@query("interval_counts", f"""
WITH i AS (SELECT id, id * 11.0 + id % 7 AS lo, id * 11.0 + id % 7 + 5 + id % 13 * 3 + CASE WHEN id % 500 = 0 THEN 20000 ELSE 0 END AS hi FROM range({P.IV_INTERVALS}) AS r(id))
SELECT i.id, CAST(count(l.l_extendedprice) AS BIGINT) AS count, round(coalesce(sum(l.l_quantity), 0), 2) AS quantity
FROM i LEFT JOIN lineitem l ON l.l_extendedprice >= i.lo AND l.l_extendedprice <= i.hi GROUP BY i.id""")
def interval_counts_prices(spark, sf):
    """Lines per price interval for 10,000 intervals, narrow and wide ones that overlap, empty ones kept."""
    lo = F.col("id") * 11.0 + F.col("id") % 7
    wide = F.when(F.col("id") % 500 == 0, 20000).otherwise(0)
    intervals = spark.range(P.IV_INTERVALS).select("id", lo.alias("lo"), (lo + 5 + F.col("id") % 13 * 3 + wide).alias("hi"))
    lines = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    out = interval_counts(lines, "l_extendedprice", intervals, "id", total="l_quantity")
    return out.select("id", "count", F.round(F.coalesce("sum", F.lit(0.0)), 2).alias("quantity"))


# ------------------------------------------------------------------ sketches


_RANGES_SQL = ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in P.SK_RANGES)


@query("distinct_by_range", f"""
WITH r(span, first_day, last_day) AS (VALUES {_RANGES_SQL}),
  e AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id * 40 + event_id % 40 AS visitor FROM events)
SELECT span, event_type, count(DISTINCT visitor) AS visitors, true AS within_error
FROM r JOIN e ON e.day BETWEEN r.first_day AND r.last_day GROUP BY span, event_type""")
def distinct_by_range(spark, sf):
    """Distinct visitors per event type over any days from stored daily sketches, beside the exact count (A2)."""
    ev = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("user_id") * 40 + F.col("event_id") % 40).alias("visitor"))
    path = scratch(spark, "sketches")
    distinct_sketches(ev, ["event_type", "day"], "visitor").write.partitionBy("day").parquet(path)
    stored = spark.read.schema("event_type string, sketch binary, day date").parquet(path)
    spans = spark.createDataFrame(P.SK_RANGES, "span string, first_day string, last_day string").select(
        "span", F.explode(F.sequence(F.col("first_day").cast("date"), F.col("last_day").cast("date"))).alias("day"))
    estimates = distinct_over(stored.join(F.broadcast(spans), "day"), ["span", "event_type"])  # a row per span and day
    exact = ev.join(F.broadcast(spans), "day").groupBy("span", "event_type").agg(F.count_distinct("visitor").alias("visitors"))
    off = F.abs(F.col("estimate") - F.col("visitors")) <= F.lit(relative_error()) * F.col("visitors") + 1
    return exact.join(estimates, ["span", "event_type"]).select("span", "event_type", "visitors", off.alias("within_error"))


@query("heavy_customers", f"""
SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank, o_custkey, count(*) AS n
FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT {P.HH_TOP_N}""")
def heavy_customers(spark, sf):
    """The most frequent customers: candidates from a merged sketch, exact counts of these alone."""
    top, _ = heavy_hitters(table(spark, sf, "orders"), "o_custkey", P.HH_TOP_N)
    return top.select("rank", F.col("item").alias("o_custkey"), "n")


# ------------------------------------------------------------------ freshness by timers

_TTL_SQL = f"CAST({case_map('source', {k: str(v) for k, v in P.SN_TTLS.items()})} AS BIGINT)"


@query("freshness_transitions", f"""
WITH s AS (SELECT DISTINCT event_type AS source, ts AS fetched_at FROM events),
  g AS (SELECT source, fetched_at, {_TTL_SQL} AS ttl, lead(fetched_at) OVER w AS next, lag(fetched_at) OVER w AS before
        FROM s WINDOW w AS (PARTITION BY source ORDER BY fetched_at))
SELECT source, fetched_at + to_seconds(ttl) AS at, 'stale' AS state, fetched_at FROM g WHERE next - fetched_at >= to_seconds(ttl)
UNION ALL
SELECT source, fetched_at, 'fresh', fetched_at FROM g WHERE before IS NULL OR fetched_at - before >= to_seconds(ttl)""")
def freshness_transitions_query(spark, sf):
    """Fresh and stale transitions of every source, replayed as a stream of landed days with event-time timers; stale ones that no
    later snapshot ends are left to the watermark and not part of the result (T1)."""
    root = scratch(spark, "freshness")
    snaps = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"))
    for first, last in zip(P.FR_CUTS, P.FR_CUTS[1:]):
        at = F.col("fetched_at")
        snaps.filter((at >= F.lit(first).cast("timestamp_ntz")) & (at < F.lit(last).cast("timestamp_ntz"))).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema("source string, fetched_at timestamp_ntz").parquet(f"{root}/landed")
        start_freshness(stream, P.SN_TTLS, f"{root}/transitions", f"{root}/checkpoint").awaitTermination()
    out = spark.read.schema("source string, at timestamp_ntz, state string, fetched_at timestamp_ntz").parquet(f"{root}/transitions")
    newest = snaps.groupBy(F.col("source").alias("s")).agg(F.max("fetched_at").alias("newest"))
    ended = out.join(F.broadcast(newest), F.col("source") == F.col("s"))  # one row per source
    return ended.filter((F.col("state") == "fresh") | (F.col("fetched_at") < F.col("newest"))).select("source", "at", "state", "fetched_at")
