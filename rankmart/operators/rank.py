"""Z-score leaderboard with a coverage gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmart.operators.dedup import top_n


def best_per_entity(df: DataFrame, entity: str, category: str, score: str) -> DataFrame:
    """Best score per (entity, category); null keys are dropped like pandas groupby.

    Partial max runs before the shuffle, so a hot entity is reduced map-side.
    """
    return (df.filter(F.col(entity).isNotNull() & F.col(category).isNotNull())
              .groupBy(entity, category)
              .agg(F.max(score).alias(score)))


def zscore_scores(df: DataFrame, entity: str, category: str, score: str,
                  min_categories: int, n_categories: int) -> DataFrame:
    """Per (entity, category): best score and z within category, qualified entities only.

    * coverage: number of (entity, category) rows, also when the best score
      is missing (F15). A window over ``entity`` on the already aggregated
      rows holds at most ``n_categories`` rows per entity, and one exchange
      replaces the aggregate + semi join of the naive plan.
    * z statistics use qualified entities only (W1); they are a per-category
      aggregate (at most ``n_categories`` rows, broadcast), not a window over
      a few huge category partitions.
    * z = (x - mean) / std, 0 when std is 0 or undefined (one row).
    """
    best = best_per_entity(df, entity, category, score)
    cover = F.count(F.lit(1)).over(Window.partitionBy(entity))
    qualified = (best.select(entity, category, score, cover.alias("_n"))
                     .filter(F.col("_n") >= min_categories))
    stats = (qualified.groupBy(category)
                      .agg(F.avg(score).alias("cat_mean"), F.stddev_samp(score).alias("cat_std")))
    z = F.when(F.col("cat_std") > 0, (F.col(score) - F.col("cat_mean")) / F.col("cat_std")).otherwise(F.lit(0.0))
    # ``stats`` has one row per category: bounded by the category list.
    return qualified.join(F.broadcast(stats), category).select(entity, category, score, z.alias("z"))


def rank_entities(scores: DataFrame, entity: str, n: int, digits: int = 9) -> DataFrame:
    """Mean z per entity, top ``n`` by it (ties: entity ascending) with ``rank`` (A4, O1).

    The mean is rounded to ``digits`` before ordering so the float summation
    order of a partition cannot reorder near-ties.
    """
    avg = scores.groupBy(entity).agg(F.round(F.avg("z"), digits).alias("avg_z"))
    return top_n(avg, [F.col("avg_z").desc_nulls_last(), F.col(entity).asc()], n)


def rank_matrix(scores: DataFrame, entity: str, category: str, categories: Sequence[str],
                score: str, n: int, scale: float = 100.0, digits: int = 9) -> DataFrame:
    """Top ``n`` entities by mean z as a wide matrix, fixed column order.

    One aggregate yields both the mean z and one column per category (a
    pivot over a given value list, written as conditional max), so the
    ranked rows never join back to the scores and the fact table is read
    once. The schema is stable: an empty category stays a null column.
    """
    wide = entity_matrix(scores, entity, category, categories, score, scale, digits)
    return top_n(wide, [F.col("avg_z").desc_nulls_last(), F.col(entity).asc()], n)


def entity_matrix(scores: DataFrame, entity: str, category: str, categories: Sequence[str],
                  score: str, scale: float = 100.0, digits: int = 9) -> DataFrame:
    """Every qualified entity: mean z and one column per category (before the top-n cut).

    ``scores`` is already partitioned by entity (the coverage window), so
    this aggregate adds no exchange.
    """
    cells = [F.max(F.when(F.col(category) == c, F.col(score) * F.lit(float(scale)))).alias(c)
             for c in categories]
    return scores.groupBy(entity).agg(F.round(F.avg("z"), digits).alias("avg_z"), *cells)


def pivot_ranked(scores: DataFrame, ranked: DataFrame, entity: str, category: str,
                 categories: Sequence[str], score: str, scale: float = 100.0) -> DataFrame:
    """DataFrame.pivot form of the matrix for an already ranked entity list (at most
    ``n`` rows, broadcast)."""
    top = scores.join(F.broadcast(ranked.select(entity)), entity, "left_semi")
    wide = (top.groupBy(entity)
               .pivot(category, list(categories))
               .agg(F.max(F.col(score) * F.lit(float(scale)))))
    return ranked.join(wide, entity, "left").orderBy("rank")


def mark_best(cells: DataFrame, category: str, score: str, rank: str = "rank") -> DataFrame:
    """is_best: the top score of each category column, best-ranked on ties.

    Runs on the shown matrix only (top-n x categories rows).
    """
    w = Window.partitionBy(category).orderBy(F.col(score).desc_nulls_last(), F.col(rank).asc())
    return cells.withColumn("is_best", F.col(score).isNotNull() & (F.row_number().over(w) == 1))
