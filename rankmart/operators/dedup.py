"""Keep-first / top-k per key (W2-W4, W7, U2, S8) and global top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list:
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def keep_first(df: DataFrame, keys, order_by, n: int = 1, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows per key under ``order_by``.

    ``order_by`` must end in a unique tiebreak so the answer does not depend
    on partitioning. Planned as row_number + filter, which Spark turns into a
    WindowGroupLimit that also runs *before* the shuffle (Partial mode): each
    map task forwards at most ``n`` rows per key, so a hot key costs no more
    shuffle than a cold one.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order_by))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w))
    out = out.filter(F.col(rn) == 1) if n == 1 else out.filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def top_n(df: DataFrame, order_by, n: int, rank_col: str | None = "rank") -> DataFrame:
    """Global top-n with a 1-based rank column (TakeOrderedAndProject).

    Each partition keeps its own top n; only n rows per partition reach the
    final merge. The rank is assigned over the n surviving rows only.
    """
    cut = df.orderBy(*_cols(order_by)).limit(n)
    if not rank_col:
        return cut
    # n rows at most: the unpartitioned window runs over the limited set only.
    w = Window.orderBy(*_cols(order_by))
    return cut.withColumn(rank_col, F.row_number().over(w).cast("long"))


def first_by_aggregate(df: DataFrame, keys, order_cols, payload, extra=()) -> DataFrame:
    """One row per key: the row with the smallest ``order_cols`` tuple, as an aggregate.

    ``order_cols`` are ascending sort keys (negate a number for descending);
    ``payload`` are the columns to carry. ``extra`` are more aggregate
    expressions over the same group (e.g. the group's first source
    position). A min over a struct is a partial aggregate: each map task
    reduces a hot key to one row before the shuffle.
    """
    order_cols = _cols(order_cols)
    payload = list(payload) if not isinstance(payload, str) else [payload]
    fields = [c.alias(f"_o{i}") for i, c in enumerate(order_cols)] + [F.col(p).alias(p) for p in payload]
    keys = _cols(keys)
    agg = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_first"), *extra)
    return agg.select(*[c for c in agg.columns if c != "_first"],
                      *[F.col(f"_first.{p}").alias(p) for p in payload])


def number_duplicates(df: DataFrame, out: str = "dup_rank", chunk: int = 1 << 20) -> DataFrame:
    """Every row with ``out`` = 1..n among the rows identical to it.

    Identical rows are interchangeable, so the ranks need no order: rows are
    counted per distinct content (a partial aggregate, so a value held by a
    third of the table is reduced map-side), each count is cut into chunks of
    ``chunk`` ranks, the chunks are spread over the cluster by hash, and each
    task regenerates only its chunks' rows. The result is the same multiset
    under any partitioning, and no task holds more than one chunk of a hot
    value at a time.
    """
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                               ((F.col("_n") - 1) / chunk).cast("long"))))
    spread = chunks.repartition("_chunk", *cols)
    lo = F.col("_chunk") * chunk + 1
    hi = F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk)
    return spread.select(*cols, F.explode(F.sequence(lo, hi)).alias(out))
