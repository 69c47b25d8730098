"""Incremental marts (T3): mergeable partial states, merged by key with each landed batch.

A mart's state is a set of small tables that a batch's own partial aggregate can be merged into, so a refresh reads the batch
and the state, never the rows landed before:

* ``leaderboard``: the best score per (entity, category) cell, and per category the count, sum and sum of squares of the
  qualified entities' best scores. Only cells of the batch's entities can change; what they contributed before is
  subtracted and what they contribute now is added, in exact decimals, so sums never drift;
* ``decayed``: per key the sum of value x weight as of the newest day seen and the row count. Weights decay exponentially,
  so a sum is carried to a later day by one factor; rows without a date have a constant weight and a sum of their own.

Each epoch's state is published as one version (``rankmart.sources.publish``): all state tables or none. An epoch that is
replayed after a failure finds its version committed and does nothing, or starts again from the version before, so a batch
counts exactly once. Old versions are removed as new ones are published.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmart.functions.dates import age_days
from rankmart.functions.numeric import trunc_to_long
from rankmart.operators.dedup import top_n
from rankmart.operators.rank import best_per_entity
from rankmart.session import checkpoint_dir
from rankmart.sources.publish import Published, Refresh, clean, newest_version

SCORE, SUM, SQUARES = "decimal(18,9)", "decimal(38,9)", "decimal(38,18)"  # a score, sums of scores and of their squares, all exact
STATS = (("n_rows", "long"), ("n", "long"), ("s", SUM), ("q", SQUARES))


class State:
    """The state of a mart as published versions, one per epoch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def merge(self, epoch: int, merged) -> bool:
        """Publish ``merged(state before or None)``, a dict of tables, as the epoch's version; False if that was done before."""
        newest = newest_version(self.spark, self.root)
        if newest is not None and newest >= epoch:
            return False
        before = None if newest is None else Published(self.spark, self.root, newest)
        with Refresh(self.spark, self.root, epoch) as refresh:
            for name, df in merged(before).items():
                refresh.put(name, df)
        clean(self.spark, self.root, keep=2)
        return True

    def read(self) -> Published:
        return Published(self.spark, self.root)


# ---------------------------------------------------------------------------------- leaderboard

def _contribution(cells: DataFrame, min_categories: int, sign: int) -> DataFrame:
    """Per category, what the qualified ones of whole entities add to count, sum and sum of squares."""
    covered = cells.groupBy("entity").agg(F.collect_list(F.struct("category", "score")).alias("c"))  # at most one per category
    rows = covered.filter(F.size("c") >= min_categories).select(F.explode("c").alias("c")).select("c.category", F.col("c.score").cast(SCORE).alias("x"))
    one = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n"), F.sum("x").alias("s"),
                                       F.sum((F.col("x") * F.col("x")).cast(SQUARES)).alias("q"))
    return one.select("category", *[(F.coalesce(c, F.lit(0)) * sign).cast(t).alias(c) for c, t in STATS])


def merge_leaderboard(batch: DataFrame, before: Published | None, min_categories: int) -> dict[str, DataFrame]:
    """State tables after a batch of (entity, category, score) rows: ``cells`` and ``stats``."""
    new = best_per_entity(batch, "entity", "category", "score")
    if before is None:
        return {"cells": new, "stats": _contribution(new, min_categories, 1)}
    cells = before.read("cells")
    merged = best_per_entity(cells.unionByName(new), "entity", "category", "score")
    touched = new.select("entity").distinct()  # only these entities' contributions change
    old_part = cells.join(touched, "entity", "left_semi")
    new_part = best_per_entity(old_part.unionByName(new), "entity", "category", "score")
    delta = (before.read("stats").unionByName(_contribution(old_part, min_categories, -1))
                   .unionByName(_contribution(new_part, min_categories, 1)))
    stats = delta.groupBy("category").agg(*[F.sum(c).cast(t).alias(c) for c, t in STATS])
    return {"cells": merged, "stats": stats.filter(F.col("n_rows") > 0)}


def leaderboard(state: Published, categories, min_categories: int, top: int, scale: float = 100.0, digits: int = 9) -> DataFrame:
    """The ranked matrix from the state: rank, entity, avg_z and a column per category."""
    cells, stats = state.read("cells"), state.read("stats")
    mean = F.col("s").cast("double") / F.col("n")
    spread = (F.col("q").cast("double") - F.col("s").cast("double") * mean) / (F.col("n") - 1)
    stats = stats.select("category", mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std"))
    scored = cells.join(F.broadcast(stats), "category")  # one row per category
    z = F.when(F.col("std") > 0, (F.col("score") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    columns = [F.max(F.when(F.col("category") == c, F.col("score") * F.lit(float(scale)))).alias(c) for c in categories]
    wide = (scored.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"), F.round(F.avg(z), digits).alias("avg_z"), *columns)
                  .filter(F.col("_n") >= min_categories).drop("_n"))
    return top_n(wide, [F.col("avg_z").desc_nulls_last(), F.col("entity").asc()], top)


# ---------------------------------------------------------------------------------- decayed sums

def merge_decayed(batch: DataFrame, before: Published | None, k: float, half_life_days: float) -> dict[str, DataFrame]:
    """State table ``sums`` after a batch of (key, value, date) rows: per key the newest day, the decayed sum as of that day,
    the plain sum of rows without a date and the row count."""
    rate = k / half_life_days
    dated, by_key = F.col("date").isNotNull(), Window.partitionBy("key")
    daily = batch.groupBy("key", "date").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))  # a hot key is a row per day
    first = daily.withColumn("day", F.max("date").over(by_key))
    weight = F.exp(F.lit(-rate) * F.datediff("day", "date"))
    sums = (first.groupBy("key").agg(F.max("day").alias("day"), F.coalesce(F.sum(F.when(dated, F.col("value") * weight)), F.lit(0.0)).alias("decayed"),
                                     F.coalesce(F.sum(F.when(~dated, F.col("value"))), F.lit(0.0)).cast("double").alias("undated"),
                                     F.sum("n").alias("n")))
    if before is None:
        return {"sums": sums}
    both = sums.unionByName(before.read("sums")).withColumn("newest", F.max("day").over(by_key))
    carried = F.col("decayed") * F.coalesce(F.exp(F.lit(-rate) * F.datediff("newest", "day")), F.lit(1.0))
    return {"sums": both.groupBy("key").agg(F.max("newest").alias("day"), F.sum(carried).alias("decayed"), F.sum("undated").alias("undated"), F.sum("n").alias("n"))}


def decayed(state: Published, as_of: str, k: float, half_life_days: float, missing_age: int) -> DataFrame:
    """(key, total, count) as of a day: the sums carried on to it. The day can't be before a key's newest row, whose age
    would count as 0 then; the job fails in that case."""
    age = age_days(F.col("day"), as_of, clamp=False)
    checked = F.when(F.coalesce(age, F.lit(0)) < 0, F.raise_error(F.lit("rows are newer than the day asked for"))).otherwise(
        F.coalesce(age, F.lit(0)))
    total = F.col("decayed") * F.exp(F.lit(-k / half_life_days) * checked) + F.col("undated") * math.exp(-k * missing_age / half_life_days)
    return state.read("sums").select("key", trunc_to_long(total).alias("total"), F.col("n").alias("count"))


# ---------------------------------------------------------------------------------- stream

def start_incremental(stream: DataFrame, parts: dict[str, tuple], state_root: str, name: str, available_now: bool = True,
                      interval: str = "5 minutes", checkpoint: str | None = None):
    """Merge every micro-batch of ``stream`` into the states of several marts; returns the StreamingQuery.

    ``parts`` maps a mart to (rows, merge): ``rows(batch)`` selects its input and ``merge(rows, state before)`` gives
    its state tables. All marts of an epoch are one version, so a reader never sees one mart ahead of another. The
    batch is read once per table written; the checkpoint lies in the cluster's shared folder.
    """
    spark = stream.sparkSession
    state = State(spark, state_root)

    def batch(df: DataFrame, epoch: int) -> None:
        def merged(before):
            out = {}
            for mart, (rows, merge) in parts.items():
                view = None if before is None else _Part(before, mart)
                out.update({f"{mart}_{table}": t for table, t in merge(rows(df), view).items()})
            return out

        state.merge(int(epoch), merged)

    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/incremental-{name}"
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


class _Part:
    """One mart's tables of a version."""

    def __init__(self, published: Published, mart: str):
        self._published, self._mart = published, mart

    def read(self, table: str) -> DataFrame:
        return self._published.read(f"{self._mart}_{table}")


def part(published: Published, mart: str) -> _Part:
    """The tables of one mart in the published state of several."""
    return _Part(published, mart)

