"""Rule tables, interval tables and mergeable sketches against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from rankmart.functions import classify_first
from rankmart.operators.intervals import first_interval, interval_counts, interval_join, on_grid
from rankmart.operators.rules import classify_table, first_rule
from rankmart.operators.sketches import distinct_over, distinct_sketches, heavy_hitters, relative_error


def rule_rows(spark, rules):
    return spark.createDataFrame([(i, p, lab) for i, (p, lab) in enumerate(rules)], "rule int, pattern string, label string")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------------------ rules

@pytest.mark.parametrize("mode", ["contains", "contains_ci", "prefix"])
def test_rule_table_is_the_chain(spark, mode):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    texts = [word(rng.randint(0, 9)) for _ in range(150)] + [None, "", "a", "ab", "ab"]
    rules = [(word(rng.randint(1, 5)), f"L{i}") for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, text string, pattern string, rule int")  # clashing names
    got = classify_table(df, "text", rule_rows(spark, rules), mode, "none", out="got")
    want = df.select("id", classify_first("text", rules, mode, "none").alias("want"))
    assert sorted(r["id"] for r in got.collect()) == list(range(len(texts)))
    both = got.join(want, "id").filter("got <> want").collect()
    assert not both and got.columns == ["id", "text", "pattern", "rule", "got"]


def test_empty_patterns_and_tables(spark):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r["label"] for r in classify_table(df, "text", rule_rows(spark, [("zzz", "z"), ("", "all"), ("abc", "late")])).orderBy("text").collect()] == [None, "all"]
    none = rule_rows(spark, [])
    assert [r["label"] for r in classify_table(df, "text", none, default="d").collect()] == ["d", "d"]
    assert first_rule(df.limit(0), "text", rule_rows(spark, [("a", "b")])).count() == 0
    assert first_rule(df, "text", rule_rows(spark, [(None, "x"), ("bc", "y")])).first()["label"] == "y"
    with pytest.raises(ValueError):
        first_rule(df, "text", none, "regex")


def test_rules_meet_texts_by_equi_joins(spark):
    from rankmart.plans.params import RT_RULES
    from rankmart.plans.scale import rule_table, rule_table_labels
    assert rule_table(spark, RT_RULES).count() == RT_RULES == rule_table(spark, RT_RULES).select("rule").distinct().count()
    plan = executed(rule_table_labels(spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------------------------ intervals

def test_interval_join_is_the_comparison(spark):
    rng = random.Random(1)
    values = [rng.uniform(-50, 200) for _ in range(300)] + [0.0, 10.0, -0.0, 1e9, 1e-9, None] + [float(i) for i in range(20)]
    intervals = [(i, lo, lo + rng.choice([0, 1e-6, 0.5, 1, 3, 64, 1000])) for i, lo in enumerate(rng.uniform(-60, 180) for _ in range(80))]
    intervals += [(100, 5.0, 5.0), (101, None, 0.0), (102, 1e8, None), (103, 7.0, 3.0), (104, None, None), (105, -1e12, 1e12), (106, 0.0, 10.0)]
    facts = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "n int, v double, key string")
    table = spark.createDataFrame(intervals, "id int, lo double, hi double")
    got = sorted((r["n"], r["id"]) for r in interval_join(facts, "v", table).collect())
    want = sorted((n, i) for n, v in enumerate(values) for i, lo, hi in intervals if v is not None and (lo is None or v >= lo) and (hi is None or v <= hi))
    assert got == want
    counts = {r["id"]: r["count"] for r in interval_counts(facts, "v", table, "id").collect()}
    assert counts == {i: sum(k == i for _, k in want) for i, _, _ in intervals}
    first = {r["n"]: r["interval"] for r in first_interval(facts, "v", table, "id").collect()}
    assert first == {n: min((i for m, i in want if m == n), default=None) for n in range(len(values))}


def test_no_interval_is_cut_into_more_than_two(spark):
    table = spark.range(2000).select("id", (F.col("id") * 1.7).alias("lo"), (F.col("id") * 1.7 + F.pow(F.lit(1.01), F.col("id"))).alias("hi"))
    most = on_grid(table).groupBy("id").count().agg(F.max("count"), F.countDistinct("id")).first()
    assert tuple(most) == (2, 2000)


def test_empty_interval_tables(spark):
    facts = spark.createDataFrame([(1.0,)], "v double")
    none = spark.createDataFrame([], "id int, lo double, hi double")
    assert interval_join(facts, "v", none).count() == 0 and interval_counts(facts, "v", none, "id").count() == 0
    one = spark.createDataFrame([(1, 0.0, 2.0)], "id int, lo double, hi double")
    assert [tuple(r) for r in interval_counts(facts.limit(0), "v", one, "id").collect()] == [(1, 0.0, 2.0, 0)]


def test_intervals_meet_values_by_equi_joins(spark):
    from rankmart.plans.scale import interval_counts_prices
    plan = executed(interval_counts_prices(spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------------------------ sketches

def test_daily_sketches_answer_any_range(spark, tmp_dir):
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 10).alias("day"), (F.col("id") * 7 % 20_011).alias("u"))
    distinct_sketches(df.filter("day < 6"), ["c", "day"], "u").write.parquet(f"{tmp_dir}/s")
    distinct_sketches(df.filter("day >= 6"), ["c", "day"], "u").write.mode("append").parquet(f"{tmp_dir}/s")  # a later snapshot
    distinct_sketches(df.filter("day = 9"), ["c", "day"], "u").write.mode("append").parquet(f"{tmp_dir}/s")   # one that lands twice
    stored = spark.read.parquet(f"{tmp_dir}/s")
    for lo, hi in ((0, 9), (3, 7), (9, 9)):
        got = {r["c"]: r["estimate"] for r in distinct_over(stored.filter(f"day BETWEEN {lo} AND {hi}"), ["c"]).collect()}
        want = {r["c"]: r["n"] for r in df.filter(f"day BETWEEN {lo} AND {hi}").groupBy("c").agg(F.countDistinct("u").alias("n")).collect()}
        assert set(got) == set(want) and all(abs(got[c] - n) <= relative_error() * n + 1 for c, n in want.items())
    assert distinct_sketches(df.limit(0), ["c"], "u").count() == 0


def exact_top(rows, n):
    import collections
    return sorted(((-k, i) for i, k in collections.Counter(rows).items()))[:n]


@pytest.mark.parametrize("tracked", [40, 1000])
def test_heavy_hitters_are_exact(spark, tracked):
    rng = random.Random(2)
    skewed = [int(rng.paretovariate(0.6)) % 5000 for _ in range(6000)]
    flat = [i % 700 for i in range(5000)]
    for rows, provable in ((skewed, tracked == 1000), (flat, False)):
        df = spark.createDataFrame([(x, "clash") for x in rows] + [(None, "")], "x int, item string").repartition(5)
        top, proved = heavy_hitters(df, "x", 4, tracked=tracked)
        assert [(-r["n"], r["item"]) for r in top.orderBy("rank").collect()] == exact_top(rows, 4)
        assert proved or not provable
    top, proved = heavy_hitters(df.limit(0), "x", 4)
    assert top.count() == 0 and proved
    few, proved = heavy_hitters(spark.createDataFrame([(1,), (1,), (2,)], "x int"), "x", 10)
    assert [tuple(r) for r in few.select("item", "n").collect()] == [(1, 2), (2, 1)] and proved
    with pytest.raises(ValueError):
        heavy_hitters(df, "x", 10, tracked=5)
