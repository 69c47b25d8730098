"""Registry of the queries on the driver tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession

from rankmart.session import apply_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL twin."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_runtime_conf(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return ", ".join(q(x) for x in xs)


def case_map(col: str, mapping: dict, default: str | None = None) -> str:
    """CASE expression for a fixed dictionary (twin of ``map_lookup``)."""
    parts = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    tail = f" ELSE {default}" if default is not None else ""
    return f"(CASE {parts}{tail} END)"


def case_groups(col: str, groups: dict) -> str:
    parts = " ".join(f"WHEN {col} IN ({sql_list(vs)}) THEN {q(k)}" for k, vs in groups.items())
    return f"(CASE {parts} END)"


def case_rules(col: str, rules, mode: str, default: str = "NULL") -> str:
    """CASE twin of ``classify_first``."""
    parts = []
    for pats, label in rules:
        if isinstance(pats, str):
            pats = [pats]
        if mode == "prefix":
            cond = " OR ".join(f"starts_with({col}, {q(p)})" for p in pats)
        elif mode == "contains":
            cond = " OR ".join(f"contains({col}, {q(p)})" for p in pats)
        else:
            cond = " OR ".join(f"contains(lower({col}), {q(p.lower())})" for p in pats)
        parts.append(f"WHEN {cond} THEN {q(label)}")
    return f"(CASE {' '.join(parts)} ELSE {default} END)"


def spark_round(expr: str, digits: int) -> str:
    """SQL twin of Spark's round() on a double: half-up on the shortest decimal text.

    A plain round works on the binary value, so results differ from Spark's just
    at ties (e.g. 42.253499999999995 -> 42.253 in Spark, 42.254 from a binary
    round). Going through the shortest text of the double removes that gap.
    """
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 17)), {digits}) AS DOUBLE)"
