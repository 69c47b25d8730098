"""Equi-join that stays balanced when a few keys hold a large share of the fact rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hot_keys(rows: DataFrame, key: str, share: float) -> list[tuple]:
    """(key, its share) of the keys that hold more than ``share`` of the rows, null aside: at most 1 / ``share`` of them, from
    one pass over the key column."""
    seen = Observation()
    counts = (rows.select(F.col(key).alias("k")).observe(seen, F.count(F.lit(1)).alias("n"))
                  .groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("k").isNotNull()))
    top = counts.orderBy(F.col("n").desc(), "k").limit(math.ceil(1 / share)).collect()
    total = seen.get["n"]
    return [(r["k"], r["n"] / total) for r in top if r["n"] > share * total]


def salted_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "inner",
                hot_share: float | None = None, salts: int | None = None,
                salt_by: Sequence[str] | None = None) -> DataFrame:
    """``fact JOIN dim ON fact_key = dim_key`` with hot keys spread over many tasks.

    * hot keys: keys holding more than ``hot_share`` of the fact rows (default:
      twice an even shuffle partition's share). One job over the key column alone
      counts them when the join is built, each task sending its partial counts; at
      most 1 / ``hot_share`` keys come back, half the shuffle width by default. Without
      hot keys the join is the plain one, with no extra scan, column or exchange;
    * each hot key gets ``salts`` salts, by default as many as its share of the
      shuffle width, so a half of all rows is dealt over half of the tasks at any size;
    * its fact rows get a salt 0..salts-1 from a hash of ``salt_by``
      (default: all fact columns), so retries and re-runs salt identically;
    * the dimension rows of hot keys are repeated once per salt (a handful
      of rows), all others carry salt 0;
    * the join is on (key, salt): the hot key's rows land in ``salts``
      different tasks instead of one.

    A dimension that AQE measures under the broadcast threshold is broadcast at
    run time by itself.

    ``fact_key`` and ``dim_key`` must be different column names (rename one
    side first when they clash). Null keys never match, as in a plain join.

    ``how`` is ``inner``, ``left`` (fact side preserved), ``left_semi`` or
    ``left_anti`` (fact rows with / without a match; every salt of a hot key
    sees all its dimension rows, so the answer is the unsalted one). AQE's
    skew-join split does the same for sort-merge joins when its size
    thresholds fire; this does not depend on them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salted_join supports inner, left, left_semi and left_anti joins")
    if fact_key == dim_key:
        raise ValueError("salted_join needs different key column names on the two sides")
    width = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = hot_share if hot_share is not None else min(0.5, 2.0 / width)
    hot = hot_keys(fact, fact_key, share)
    if not hot:
        return fact.join(dim, F.col(fact_key) == F.col(dim_key), how)
    spark = fact.sparkSession
    rows = [(k, int(salts) if salts else max(2, math.ceil(part * width))) for k, part in hot]
    schema = T.StructType([T.StructField("_hk", fact.schema[fact_key].dataType), T.StructField("_salts", T.IntegerType())])
    hot = spark.createDataFrame(rows, schema)  # at most 1 / share rows
    cols = list(salt_by) if salt_by else fact.columns
    f = (fact.join(F.broadcast(hot), F.col(fact_key) == F.col("_hk"), "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*cols), F.col("_salts")), F.lit(0).cast("long")))
             .drop("_hk", "_salts"))
    d = (dim.join(F.broadcast(hot), F.col(dim_key) == F.col("_hk"), "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("_salts", F.lit(1)) - 1).cast("long"))))
            .drop("_hk", "_salts"))
    cond = (F.col(fact_key) == F.col(dim_key)) & (f["_salt"] == d["_salt"])
    joined = f.join(d, cond, how).drop(f["_salt"])
    return joined if how in ("left_semi", "left_anti") else joined.drop(d["_salt"])
