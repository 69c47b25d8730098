"""Operators not covered through a mart: pivot form, column winners, table lookups, guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rankmart.operators import (
    assert_rows, dim_frame, entity_matrix, first_by_aggregate, lookup, mark_best, pivot_ranked, rank_entities,
    zscore_scores,
)
from rankmart.streaming import latest_snapshot


def scores(spark):
    rows = [("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 3.0), ("c", "x", 2.0), ("c", "y", 2.0),
            ("d", "x", 9.0)]
    return zscore_scores(spark.createDataFrame(rows, "e string, c string, s double"), "e", "c", "s", 2, 2)


def test_pivot_form_equals_conditional_aggregate(spark):
    sc = scores(spark)
    ranked = rank_entities(sc, "e", 2)
    piv = pivot_ranked(sc, ranked, "e", "c", ["x", "y"], "s", 1.0).orderBy("rank").collect()
    cond = {r["e"]: r for r in entity_matrix(sc, "e", "c", ["x", "y"], "s", 1.0).collect()}
    assert "d" not in cond  # one of two categories: below the coverage gate
    assert [r["e"] for r in piv] == [r["e"] for r in ranked.orderBy("rank").collect()]
    for r in piv:
        assert (r["x"], r["y"], r["avg_z"]) == (cond[r["e"]]["x"], cond[r["e"]]["y"], cond[r["e"]]["avg_z"])


def test_mark_best_ties_go_to_better_rank(spark):
    cells = spark.createDataFrame([(1, "x", 5.0), (2, "x", 5.0), (1, "y", None), (2, "y", 1.0)],
                                  "rank int, c string, v double")
    best = {(r["rank"], r["c"]): r["is_best"] for r in mark_best(cells, "c", "v").collect()}
    assert best == {(1, "x"): True, (2, "x"): False, (1, "y"): False, (2, "y"): True}


def test_table_lookup_default_and_inner(spark):
    facts = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string")
    dim = dim_frame(spark, [("k1", "one")], "k string, name string")
    left = {r["k"]: r["name"] for r in lookup(facts, dim, "k", "name", default="Other", bounded=True).collect()}
    assert left == {"k1": "one", "k2": "Other", None: "Other"}
    inner = [r["k"] for r in lookup(facts, dim, "k", "name", how="inner").collect()]
    assert inner == ["k1"]


def test_assert_rows(spark):
    src = spark.createDataFrame([("a",), ("b",)], "v string")
    assert assert_rows(src, "feed") is src
    with pytest.raises(ValueError, match="Available v"):
        assert_rows(src.filter("v = 'z'"), "feed", "v", src)


def test_first_by_aggregate(spark):
    df = spark.createDataFrame([("f", 10, 2, "late"), ("f", 10, 1, "early"), ("g", 3, 5, "only")],
                               "k string, size int, pos int, name string")
    got = {r["k"]: (r["name"], r["first"]) for r in first_by_aggregate(
        df, "k", [-F.col("size"), F.col("pos")], ["name"], extra=[F.min("pos").alias("first")]).collect()}
    assert got == {"f": ("early", 1), "g": ("only", 5)}


def test_latest_snapshot_default_ttl(spark):
    snaps = spark.createDataFrame([("x", dt.datetime(2025, 1, 1, 0, 0))], "source string, fetched_at timestamp_ntz")
    row = latest_snapshot(snaps, "2025-01-01 00:10:00", {}, default_ttl=300).first()
    assert row["ttl_seconds"] == 300 and row["is_fresh"] is False
    future = latest_snapshot(snaps, "2024-12-31 00:00:00", {"x": 300})
    assert future.count() == 0  # snapshots after as_of do not exist yet


def test_check_rows(spark):
    from rankmart.operators import check_rows
    df = spark.createDataFrame([(1.0,), (2.0,)], "p double")
    assert check_rows(df, F.col("p") > 0, "price must be positive").count() == 2
    bad = check_rows(spark.createDataFrame([(1.0,), (None,)], "p double"), F.col("p") > 0, "price must be positive")
    with pytest.raises(Exception, match="price must be positive"):
        bad.collect()


def test_salted_join_equals_plain_join(spark):
    from rankmart.operators import salted_join
    fact = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)] + [(999, 5)], "k long, v long")
    dim = spark.createDataFrame([(k, f"name{k}") for k in range(0, 300, 3)] + [(0, "zero")], "dk long, name string")
    dim = dim.dropDuplicates(["dk"])
    for how in ("inner", "left"):
        plain = sorted(tuple(r) for r in fact.join(dim, fact.k == dim.dk, how).collect())
        salted = sorted(tuple(r) for r in salted_join(fact, dim, "k", "dk", how, hot_share=0.05, salts=4).collect())
        assert salted == plain
    with pytest.raises(ValueError):
        salted_join(fact, dim, "k", "dk", "right")


def test_salted_semi_anti_and_wrappers(spark):
    from rankmart.operators import append_missing, salted_join
    fact = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(200)], "k long, v long")
    dim = spark.createDataFrame([(k,) for k in range(0, 200, 4)], "dk long")
    for how in ("left_semi", "left_anti"):
        plain = sorted(tuple(r) for r in fact.join(dim, fact.k == dim.dk, how).collect())
        salted = sorted(tuple(r) for r in salted_join(fact, dim, "k", "dk", how, hot_share=0.05, salts=4).collect())
        assert salted == plain
    a = spark.createDataFrame([("GPT-4",), ("Claude",)], "model string")
    b = spark.createDataFrame([(" gpt-4 ",)] * 30 + [("Gemini",), ("claude",)], "model string")
    assert sorted(r[0] for r in append_missing(a, b, "model", "model", salted=True).collect()) == \
        sorted(r[0] for r in append_missing(a, b, "model", "model").collect()) == ["Claude", "GPT-4", "Gemini"]
    dim2 = dim_frame(spark, [(0, "zero"), (4, "four")], "k long, name string")
    plain = sorted(tuple(r) for r in lookup(fact, dim2, "k", "name", default="?").collect())
    salted = sorted(tuple(r) for r in lookup(fact, dim2, "k", "name", default="?", salted=True).collect())
    assert salted == plain


def test_salted_join_takes_its_salts_from_the_keys_share(spark):
    from rankmart.operators import salted_join
    fact = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(90)], "k long, v long")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(0, 90, 3)], "dk long, name string")
    plain = sorted(tuple(r) for r in fact.join(dim, fact.k == dim.dk).collect())
    small = salted_join(fact, dim, "k", "dk")
    big = salted_join(fact, dim, "k", "dk", hot_share=0.05, salts=4)
    assert sorted(tuple(r) for r in small.collect()) == plain == sorted(tuple(r) for r in big.collect())
    for df in (small, big):
        assert "_salt" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in big._jdf.queryExecution().optimizedPlan().toString()
