"""M1 leaderboard on the driver's events table.

entity = user-day, category = event type through a one-to-many map,
score = value. Operators: S1-like scan, J7 F1 A1 F15 J2 W1 A3 A4 O1 A6 J10
W8 X17 X27 X28 X29 X31 A5 A19.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import map_lookup_inverse, rank_label, truncate_label, epoch_utc_label
from rankmart.operators import (
    best_per_entity, entity_matrix, mark_best, minmax_scale, rank_matrix, top_n, zscore_scores,
)
from rankmart.plans import params as P
from rankmart.plans.registry import case_groups, q, query, spark_round
from rankmart.sources import table

CATS = list(P.LB_CATEGORIES)


def lb_input(spark, sf):
    """events -> (entity, category, score, ts)."""
    ev = table(spark, sf, "events")
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"),
                 F.to_date("ts").cast("string")).alias("entity"),
        map_lookup_inverse(F.col("event_type"), P.LB_CATEGORIES).alias("category"),
        F.col("value").alias("score"),
        F.col("ts"),
    )


def lb_scores(spark, sf):
    return zscore_scores(lb_input(spark, sf), "entity", "category", "score",
                         P.LB_MIN_CATEGORIES, len(CATS))


def lb_matrix(spark, sf):
    return rank_matrix(lb_scores(spark, sf), "entity", "category", CATS, "score", P.LB_TOP_N, P.LB_SCALE)


_SQL_IN = f"""
  lb_in AS (
    SELECT 'u' || CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d') AS entity,
           {case_groups('event_type', P.LB_CATEGORIES)} AS category,
           value AS score, ts
    FROM events),
  lb_best AS (SELECT entity, category, max(score) AS score FROM lb_in
              WHERE entity IS NOT NULL AND category IS NOT NULL GROUP BY entity, category)"""

_SQL_SCORES = _SQL_IN + f""",
  lb_q AS (SELECT * FROM lb_best WHERE entity IN
             (SELECT entity FROM lb_best GROUP BY entity HAVING count(*) >= {P.LB_MIN_CATEGORIES})),
  lb_st AS (SELECT category, avg(score) AS mu, stddev_samp(score) AS sd FROM lb_q GROUP BY category),
  lb_z AS (SELECT q.entity, q.category, q.score,
                  CASE WHEN st.sd > 0 THEN (q.score - st.mu) / st.sd ELSE 0.0 END AS z
           FROM lb_q q JOIN lb_st st USING (category)),
  lb_wide AS (SELECT entity, round(avg(z), 9) AS avg_z,
                {", ".join(f'max(CASE WHEN category = {q(c)} THEN score * {P.LB_SCALE} END) AS "{c}"' for c in CATS)}
              FROM lb_z GROUP BY entity),
  lb_top AS (SELECT *, row_number() OVER (ORDER BY avg_z DESC NULLS LAST, entity) AS rank
             FROM lb_wide ORDER BY avg_z DESC NULLS LAST, entity LIMIT {P.LB_TOP_N})"""


@query("zscore_leaderboard", f"""
WITH {_SQL_SCORES}
SELECT rank, entity, round(avg_z, 6) AS avg_z, {", ".join(f'"{c}"' for c in CATS)}
FROM lb_top ORDER BY rank""")
def zscore_leaderboard(spark, sf):
    """Top entities by mean z-score across categories, one column per category (M1 matrix)."""
    return lb_matrix(spark, sf).select("rank", "entity", F.round("avg_z", 6).alias("avg_z"), *CATS)


@query("coverage_gate", f"""
WITH {_SQL_IN}
SELECT entity, count(*) AS n_categories FROM lb_best
GROUP BY entity HAVING count(*) >= {P.LB_MIN_CATEGORIES}""")
def coverage_gate(spark, sf):
    """Entities with best scores in at least N-1 of the N categories."""
    best = best_per_entity(lb_input(spark, sf), "entity", "category", "score")
    return (best.groupBy("entity").agg(F.count(F.lit(1)).alias("n_categories"))
                .filter(F.col("n_categories") >= P.LB_MIN_CATEGORIES))


_CELLS_SQL = ", ".join(f"({q(c)})" for c in CATS)
_CELL_PICK = " ".join(f'WHEN {q(c)} THEN t."{c}"' for c in CATS)


@query("leaderboard_cells", f"""
WITH {_SQL_SCORES},
  cells AS (SELECT t.rank, t.entity, c.category, CASE c.category {_CELL_PICK} END AS score_pct
            FROM lb_top t CROSS JOIN (VALUES {_CELLS_SQL}) AS c(category)),
  bounds AS (SELECT min(score_pct) AS mn, max(score_pct) AS mx FROM cells)
SELECT rank, entity,
       '#' || CAST(rank AS VARCHAR) || '  ' ||
         (CASE WHEN length(entity) <= {22} THEN entity ELSE substr(entity, 1, 21) || '…' END) AS label,
       category, score_pct,
       (score_pct IS NOT NULL AND
        row_number() OVER (PARTITION BY category ORDER BY score_pct DESC NULLS LAST, rank) = 1) AS is_best,
       round(CASE WHEN mx > mn THEN (score_pct - mn) / (mx - mn) ELSE 0.5 END, 6) AS intensity
FROM cells, bounds""")
def leaderboard_cells(spark, sf):
    """Long form of the shown matrix: label, column winner, 0-1 colour intensity."""
    wide = lb_matrix(spark, sf)
    cells = wide.unpivot(["rank", "entity"], CATS, "category", "score_pct")
    cells = mark_best(cells, "category", "score_pct", "rank")
    cells = minmax_scale(cells, "score_pct", 0.0, 1.0, 0.5, "intensity")
    return cells.select("rank", "entity", rank_label("rank", truncate_label("entity", 22)).alias("label"),
                        "category", "score_pct", "is_best", F.round("intensity", 6).alias("intensity"))


_BEST_CAT_SQL = " ".join(f'WHEN t."{c}" = g.v THEN {q(c)}' for c in CATS)


@query("leaderboard_kpis", f"""
WITH {_SQL_SCORES},
  g AS (SELECT greatest({", ".join(f'"{c}"' for c in CATS)}) AS v FROM lb_top WHERE rank = 1),
  top1 AS (SELECT t.entity AS top_entity, (CASE {_BEST_CAT_SQL} END) AS top_category, g.v AS top_value
           FROM lb_top t, g WHERE t.rank = 1),
  k AS (SELECT (SELECT count(DISTINCT entity) FROM lb_in) AS total_evaluated,
               (SELECT count(DISTINCT entity) FROM lb_q) AS n_qualified,
               (SELECT count(*) FROM lb_top) AS n_shown,
               (SELECT max(ts) FROM lb_in WHERE category IS NOT NULL) AS last_ts)
SELECT total_evaluated, n_qualified, n_shown, total_evaluated - n_shown AS n_dropped, last_ts,
       strftime(last_ts, '%Y-%m-%d %H:%M') || ' UTC' AS updated_label,
       top_entity, top_category, top_value,
       printf({q(fixed.INSIGHT_LEADERBOARD)},
              top_entity, top_category, {spark_round('top_value', 1)},
              n_shown, total_evaluated, total_evaluated - n_shown) AS insight
FROM k, top1""")
def leaderboard_kpis(spark, sf):
    """One insight row: evaluated / qualified / shown / dropped, freshness, leader."""
    inp = lb_input(spark, sf)
    every = entity_matrix(lb_scores(spark, sf), "entity", "category", CATS, "score", P.LB_SCALE)
    wide = top_n(every, [F.col("avg_z").desc_nulls_last(), F.col("entity").asc()], P.LB_TOP_N)
    best_v = F.greatest(*[F.col(c) for c in CATS])
    best_c = None
    for c in CATS:  # first column holding the maximum (idxmax)
        best_c = F.when(F.col(c) == F.col("top_value"), F.lit(c)) if best_c is None else best_c.when(F.col(c) == F.col("top_value"), F.lit(c))
    top1 = (wide.filter(F.col("rank") == 1)
                .withColumn("top_value", best_v)
                .select(F.col("entity").alias("top_entity"), best_c.alias("top_category"), "top_value"))
    k1 = inp.agg(F.count_distinct("entity").alias("total_evaluated"),
                 F.max(F.when(F.col("category").isNotNull(), F.col("ts"))).alias("last_ts"))
    # Counting the whole matrix row keeps every column alive, so this branch is the
    # same sub-plan as the ranking one and shares its exchanges.
    k2 = every.agg(F.count(F.struct(*every.columns)).alias("n_qualified"))
    one = (k1.crossJoin(k2).crossJoin(top1)  # single-row frames
             .withColumn("n_shown", F.least(F.col("n_qualified"), F.lit(P.LB_TOP_N).cast("long"))))
    dropped = F.col("total_evaluated") - F.col("n_shown")
    return one.select(
        "total_evaluated", "n_qualified", "n_shown", dropped.alias("n_dropped"), "last_ts",
        epoch_utc_label(F.unix_timestamp(F.col("last_ts").cast("timestamp"))).alias("updated_label"),
        "top_entity", "top_category", "top_value",
        F.format_string(fixed.INSIGHT_LEADERBOARD,
                        "top_entity", "top_category", F.round("top_value", 1), "n_shown", "total_evaluated", dropped).alias("insight"),
    )
