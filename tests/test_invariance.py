"""SURVEY §5 properties: permuting or repartitioning the input never changes a mart;
z-scores have mean 0 within each category."""

import math

from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.plans import marts as M
from rankmart.sources import feeds as S
from test_marts import BENCH_OF, CATS, catalog_rows, hub


def shuffled(df):
    return df.orderBy(F.rand(11)).repartition(5)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def bench(spark):
    rows = []
    for i, g in enumerate("ABCDEFG"):
        for j, c in enumerate(CATS):
            if (i + j) % 6:
                rows.append(("m", g, BENCH_OF[c], round(0.1 + ((i * 7 + j * 3) % 10) / 11, 4), f"2025-0{1 + j}-01"))
    return spark.createDataFrame(rows, S.BENCH_SCORES)


def test_leaderboard_invariant_and_z_centred(spark):
    b = bench(spark)
    assert rows_of(M.leaderboard_matrix(b)) == rows_of(M.leaderboard_matrix(shuffled(b)))
    means = M.leaderboard_scores(b).groupBy("category").agg(F.avg("z").alias("m"), F.count("z").alias("n")).collect()
    assert means and all(abs(r["m"]) < 1e-12 for r in means if r["n"] > 1)


def test_catalog_marts_invariant(spark):
    rows = [(f"openai/m{i % 5}-2025-0{1 + i % 3}-01", f"n{i}", 1748000000 - i * 1000, 4096 * (1 + i % 9),
             "0.000001", "0.000002", ["text", "image"][: 1 + i % 2], ["text"]) for i in range(30)]
    cat = catalog_rows(spark, rows)
    for build in (lambda c: M.pricing(c, "2025-06-01 00:00:00"), lambda c: M.context_buckets(spark, c),
                  M.capabilities, M.context_insight):
        assert rows_of(build(cat)) == rows_of(build(shuffled(cat)))


def test_hub_marts_invariant(spark):
    rows = [(f"org{i % 4}/m{i}", 10 * i, i, f"2025-0{1 + i % 5}-1{i % 9}", "text-generation", None, float(i))
            for i in range(40)]
    h = hub(spark, rows)
    assert rows_of(M.downloads(h, "2025-06-01")) == rows_of(M.downloads(shuffled(h), "2025-06-01"))
    assert rows_of(M.trending(h, "2025-06-01")) == rows_of(M.trending(shuffled(h), "2025-06-01"))


def test_chip_and_timeline_invariant(spark):
    hw = spark.createDataFrame([(m,) for m in ["NVIDIA"] * 5 + ["AMD"] * 5 + ["Huawei"] * 3 + [None]], S.ML_HARDWARE)
    assert rows_of(M.chip_dominance(hw)) == rows_of(M.chip_dominance(shuffled(hw)))
    assert rows_of(M.chip_insight(hw)) == rows_of(M.chip_insight(shuffled(hw)))
    notable = spark.createDataFrame([(f"Model {i}", ["OpenAI", "Google", "Meta AI"][i % 3], f"202{i % 5}-0{1 + i % 9}-01",
                                      str(10.0 ** (20 + i % 6)) if i % 4 else "", str(i)) for i in range(30)],
                                    S.NOTABLE_MODELS)
    tl = M.timeline(notable)
    assert rows_of(M.timeline_sizes(tl)) == rows_of(M.timeline_sizes(shuffled(tl)))
    assert rows_of(M.timeline_insight(tl, "2025-06-01")) == rows_of(M.timeline_insight(shuffled(tl), "2025-06-01"))
    assert not any(math.isnan(r["size"]) for r in M.timeline_sizes(tl).collect() if r["size"] is not None)
