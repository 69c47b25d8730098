"""Dimension lookups (J4-J8) and source guards."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lookup(c, mapping: dict, default=None) -> Column:
    """Look a value up in a fixed dictionary.

    A fixed map becomes a literal map expression: no join, no shuffle, and
    it stays inside whole-stage codegen. ``default`` may be a literal, a
    Column (e.g. the key itself, J5) or None (unmatched -> null, J4).
    """
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    hit = F.try_element_at(m, _c(c))
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def map_lookup_inverse(c, groups: dict, default=None) -> Column:
    """Look a value up in a one-to-many map {out: [values...]}."""
    flat = {v: k for k, vs in groups.items() for v in vs}
    return map_lookup(c, flat, default)


def dim_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small dimension from literal rows (its size is the literal's size)."""
    return spark.createDataFrame(list(rows), schema)


def lookup(df: DataFrame, dim: DataFrame, on, out: str, default=None,
           how: str = "left", bounded: bool = False, salted: bool = False) -> DataFrame:
    """Join a dimension table; unmatched rows get ``default`` (left) or drop (inner).

    ``bounded=True`` marks a dimension whose row count is known to be small
    (a literal list): only then it is broadcast by hint. Table dimensions are
    left to AQE, which broadcasts them only when their measured size is under
    the threshold; ``salted=True`` (single key column) joins them with
    ``salted_join`` so a key holding a large share of ``df`` is spread out.
    """
    if salted and not bounded and isinstance(on, str):
        # keys holding a large share of ``df`` are spread over several tasks
        from rankmart.operators.skew import salted_join
        res = salted_join(df, dim.withColumnRenamed(on, "_dk"), on, "_dk", how).drop("_dk")
    else:
        d = F.broadcast(dim) if bounded else dim
        res = df.join(d, on=on, how=how)
    if default is not None and how == "left":
        res = res.withColumn(out, F.coalesce(F.col(out), default if isinstance(default, Column) else F.lit(default)))
    return res


def assert_rows(df: DataFrame, what: str, sample_col: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Fail the job when a source yields no usable row.

    The check is ``isEmpty`` (reads at most one row); the error carries a
    few distinct sample values of the unfiltered source to explain why.
    """
    if df.isEmpty():
        hint = ""
        if sample_col is not None and source is not None:
            vals = [r[0] for r in source.select(sample_col).distinct().limit(20).collect()]
            hint = f" Available {sample_col}: {vals}"
        raise ValueError(f"No usable rows for {what}.{hint}")
    return df


def check_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Row-level guard (S12): the job fails on the first row where ``condition`` is false.

    The check is an expression evaluated where the rows already flow (no extra
    pass, no driver round trip); rows pass through unchanged. Null counts as
    a violation.
    """
    ok = F.coalesce(condition, F.lit(False))
    # A filter keeps the check in the plan (an unused column would be pruned away).
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).isNull()))
