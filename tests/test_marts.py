"""The twelve marts on tiny inline rows shaped like the source feeds (FIXTURES.md part A)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.plans import marts as M
from rankmart.sources import feeds as S

CATS = list(fixed.CATEGORY_MAP)
BENCH_OF = {c: bs[0] for c, bs in fixed.CATEGORY_MAP.items()}


def bench_rows(spark, rows):
    return spark.createDataFrame(rows, S.BENCH_SCORES)


def test_leaderboard_gate_and_z(spark):
    rows = []
    # A, B, C: all 5 categories; D: exactly 4 (kept); E: 3 (dropped)
    for m, cats, base in [("A", CATS, 0.9), ("B", CATS, 0.5), ("C", CATS, 0.1), ("D", CATS[:4], 0.7), ("E", CATS[:3], 0.99)]:
        for c in cats:
            rows.append((m + "-run", m, BENCH_OF[c], base, "2025-01-01"))
    rows.append(("A-run", "A", "MATH level 5", 0.95, "2025-03-01"))  # best of two for A/Math
    rows.append(("x", "A", "Unmapped bench", 1.0, "2026-01-01"))    # ignored
    rows.append(("y", None, "WeirdML", 1.0, "2026-01-01"))          # null group ignored
    mat = {r["model_group"]: r for r in M.leaderboard_matrix(bench_rows(spark, rows)).collect()}
    assert set(mat) == {"A", "B", "C", "D"}
    assert mat["A"]["rank"] == 1 and mat["A"]["Math"] == pytest.approx(95.0)
    assert mat["D"]["Common Sense"] is None
    ins = M.leaderboard_insight(bench_rows(spark, rows)).first()
    assert ins["total_evaluated"] == 5 and ins["num_dropped"] == 1
    # last_date is over every mapped-benchmark row, also those without a model group
    assert ins["last_date"] == "2026-01-01" and ins["top_model"] == "A"


def test_single_qualified_score_gives_z_zero(spark):
    rows = [("m", "A", BENCH_OF[c], 0.5, "2025-01-01") for c in CATS[:4]]
    sc = M.leaderboard_scores(bench_rows(spark, rows)).collect()
    assert len(sc) == 4 and all(r["z"] == 0.0 for r in sc)


def test_leaderboard_no_match_raises(spark):
    with pytest.raises(ValueError, match="mapped benchmarks is in the feed"):
        M.leaderboard_matrix(bench_rows(spark, [("m", "A", "Other", 0.5, "2025-01-01")]))


def catalog_rows(spark, rows):
    data = []
    for i, r in enumerate(rows):
        rid, name, created, ctx, prompt, completion, ins, outs = r
        data.append(("f", i, rid, name, created, ctx, (prompt, completion), (ins, outs)))
    schema = "src_file string, src_pos int, " + S.CATALOG_MODEL.simpleString()[len("struct<"):-1].replace(":", " ")
    return spark.createDataFrame(data, schema)


AS_OF = "2025-06-01 00:00:00"
NOW = int(dt.datetime(2025, 6, 1).timestamp())


def test_pricing_filters_and_dedup(spark):
    d = 86400
    rows = [
        ("openai/p-missing", "m", NOW - d, 1000, None, "0.000001", None, None),
        ("openai/p-blank", "b", NOW - d, 1000, "", "0.000001", None, None),
        ("openai/p-zero", "z", NOW - d, 1000, "0", "0.000001", None, None),
        ("openai/p-neg", "n", NOW - d, 1000, "-0.000001", "0.000001", None, None),
        ("openai/p-cap", "cap", NOW - d, 1000, "0.0001", "0.0001", None, None),       # exactly 100 per 1M: kept
        ("openai/p-over", "over", NOW - d, 1000, "0.00010001", "0.000001", None, None),
        ("openai/gpt-4o-2024-11-20", "new", NOW - d, 1000, "0.000002", "0.000004", None, None),
        ("openai/gpt-4o-2024-08-06", "old", NOW - 2 * d, 1000, "0.000002", "0.000004", None, None),
        ("openai/ancient", "anc", NOW - 400 * d, 1000, "0.000002", "0.000004", None, None),
        ("someone/x", "x", NOW - d, 1000, "0.000002", "0.000004", None, None),
    ]
    got = {r["name"]: r for r in M.pricing(catalog_rows(spark, rows), AS_OF).collect()}
    assert set(got) == {"cap", "new"}
    assert got["new"]["prompt_1m"] == 2.0 and got["new"]["completion_1m"] == 4.0


def test_context_buckets_edges_and_ties(spark):
    rows = [("o/a", "a", 0, 8192, "1", "1", None, None), ("o/b", "b", 0, 8193, "1", "1", None, None),
            ("o/c", "c", 0, 1048576, "1", "1", None, None), ("o/d", "d", 0, 1048577, "1", "1", None, None),
            ("o/e", "e", 0, 0, "1", "1", None, None), ("o/f", "f", 0, None, "1", "1", None, None),
            ("o/g-2024-01", "g1", 0, 5000, "1", "1", None, None), ("o/g:free", "g2", 0, 5000, "1", "1", None, None),
            ("openrouter/auto", "auto", 0, 9000, "1", "1", None, None)]
    b = M.context_buckets(spark, catalog_rows(spark, rows)).orderBy("ord").collect()
    assert [r["count"] for r in b] == [2, 1, 0, 0, 1, 1]
    assert b[0]["examples"] == "a, g1"      # g family: equal largest, first position wins
    assert b[2]["examples"] == "—"
    assert sum(r["count"] for r in b) == 5


def test_capabilities_null_arrays(spark):
    rows = [("openai/m-2024-01-01", "m1", 0, 1, "1", "1", ["text"], None),
            ("openai/m-2024-02-01", "m2", 0, 1, "1", "1", ["text", "image"], ["image"]),
            ("google/g", "g", 0, 1, "1", "1", None, None)]
    got = {r["org"]: r for r in M.capabilities(catalog_rows(spark, rows)).collect()}
    assert got["openai"]["total_models"] == 1 and got["openai"]["Vision"] == 1 and got["openai"]["Image gen"] == 1
    assert got["google"]["Vision"] == 0 and got["openai"]["display_name"] == "OpenAI"


def test_timeline_anti_join_and_flagship(spark):
    notable = spark.createDataFrame([
        ("GPT-4", "OpenAI", "2023-03-14", "2.1e25", "1e12"),
        ("Claude 3 Opus", "Anthropic", "2024-03-04", "", "bad"),
        ("Old", "OpenAI", "2019-01-01", "1e20", None),
        ("Multi", "Google,Meta AI", "2024-01-01", "1e24", None),
        ("Nobody", "Unknown Lab", "2024-01-01", "1e24", None),
    ], S.NOTABLE_MODELS)
    bench = bench_rows(spark, [
        ("x", " gpt-4 ", "b", 0.5, "2025-05-01"),
        ("x", "Gemini 3 Pro", "b", 0.5, "2025-05-01"),
        ("x", "Gemini 3 Flash", "b", 0.5, "2025-05-02"),
        ("x", "Mystery", "b", 0.5, "2025-05-01")])
    tl = M.timeline(notable, bench)
    got = {r["model"]: r for r in tl.collect()}
    assert set(got) == {"GPT-4", "Claude 3 Opus", "Gemini 3 Pro", "Gemini 3 Flash"}
    assert got["Claude 3 Opus"]["has_compute"] is False and got["Claude 3 Opus"]["parameters"] is None
    fl = {r["model"] for r in M.flagship(tl.filter(~F.col("has_compute")), "2025-06-01").collect()}
    assert fl == {"Gemini 3 Pro"}   # one family, Pro (tier 4) beats Flash (tier 1); Claude is too old
    ins = M.timeline_insight(tl, "2025-06-01").first()
    assert ins["biggest_model"] == "GPT-4" and ins["num_recent"] == 1


def test_timeline_sizes_group_median(spark):
    tl = spark.createDataFrame([
        ("a", "X", dt.date(2024, 1, 1), 1.0, 10.0, True), ("b", "X", dt.date(2024, 1, 1), 1.0, 1000.0, True),
        ("c", "X", dt.date(2024, 1, 1), 1.0, None, True),
        ("d", "Y", dt.date(2024, 1, 1), 1.0, None, True), ("e", "Y", dt.date(2024, 1, 1), 1.0, None, True),
        ("f", "Z", dt.date(2024, 1, 1), 1.0, 0.5, True)],
        "model string, org string, date date, compute_flop double, parameters double, has_compute boolean")
    s = {r["model"]: r["size"] for r in M.timeline_sizes(tl).collect()}
    # c is filled with the median of the clipped values (505), then logged
    assert s["a"] == pytest.approx(6.0) and s["b"] == pytest.approx(22.0)
    assert s["c"] == pytest.approx(6.0 + (math.log10(505.0) - 1.0) / 2.0 * 16.0)
    assert s["d"] == 12.0 and s["e"] == 12.0 and s["f"] == 12.0


def test_chip_dominance(spark):
    hw = spark.createDataFrame([("NVIDIA",)] * 3 + [("Huawei",)] * 2 + [("Acme",), (None,)], S.ML_HARDWARE)
    top = M.chip_dominance(hw).orderBy("rank").collect()
    assert [(r["manufacturer"], r["count"], r["country"]) for r in top] == [
        ("NVIDIA", 3, "US"), ("Huawei", 2, "China"), ("Acme", 1, "Other")]
    st = M.chip_insight(hw).first()
    assert st["total"] == 7 and st["us_count"] == 3 and st["cn_makers"] == 1 and st["top_maker"] == "NVIDIA"
    assert st["top_share"] == pytest.approx(3 / 7 * 100, abs=1e-6)


def clusters(spark, rows):
    return spark.createDataFrame(rows, S.GPU_CLUSTERS)


def test_gpu_map_jitter_and_fallbacks(spark):
    one_flag = clusters(spark, [
        ("Anonymized A", "O", "China", None, None, 30.0, 110.0, "100", "5"),
        ("Site", "O", "France", "Op", "H100", 48.0, 2.0, "100", None),
        ("No coords", "O", "Spain", "Op", "H100", None, 2.0, "100", None)])
    m = {r["name"]: r for r in M.gpu_map(one_flag).collect()}
    assert set(m) == {"Anonymized A", "Site"}
    assert m["Anonymized A"]["lat"] == 30.0                   # one flagged row: no jitter
    assert m["Site"]["region"] == "Europe" and m["Anonymized A"]["region"] == "China"
    assert m["Site"]["dot_size"] == 10.0                      # all values equal -> fallback
    assert m["Anonymized A"]["status"] == "Unknown" and m["Anonymized A"]["chip_type"] == "Not disclosed"
    many = clusters(spark, [("Anonymized cluster", "O", "China", None, None, 30.0, 110.0, "x", None)] * 4)
    pts = M.gpu_map(many).collect()
    assert all(abs(r["lat"] - 30.0) <= 5 and abs(r["lon"] - 110.0) <= 8 for r in pts)
    assert len({(r["lat"], r["lon"]) for r in pts}) == 4      # identical rows still spread
    again = sorted((r["lat"], r["lon"]) for r in M.gpu_map(many.repartition(3)).collect())
    assert again == sorted((r["lat"], r["lon"]) for r in pts)
    st = M.gpu_stats(many).first()
    assert st["total_clusters"] == 4 and st["total_mw"] == 0.0


def hub(spark, rows):
    data = [("f", i) + r for i, r in enumerate(rows)]
    schema = "src_file string, src_pos int, " + S.HUB_MODEL.simpleString()[len("struct<"):-1].replace(":", " ")
    return spark.createDataFrame(data, schema)


def test_downloads_decay(spark):
    rows = [("Qwen/a", 1000, 1, "2025-06-01T00:00:00Z", "text-generation", None, None),
            ("Qwen/b", 1000, 1, "2025-04-02T00:00:00Z", "text-generation", None, None),   # 60 days
            ("meta-llama/c", 1000, 1, None, "text-generation", None, None),               # missing -> 365 days
            ("meta-llama/d", 1000, 1, "2026-01-01", "text-generation", None, None),       # future -> 0 days
            ("noslash", 10 ** 9, 1, "2025-06-01", "text-generation", None, None),         # community: excluded
            ("dphn/e", 10 ** 9, 1, "2025-06-01", "text-generation", None, None)]
    got = {r["org"]: r for r in M.downloads(hub(spark, rows), "2025-06-01").collect()}
    assert set(got) == {"Qwen", "meta-llama"}
    assert got["Qwen"]["downloads"] == int(1000 + 1000 * 2.718281828459045 ** -0.693)
    assert got["Qwen"]["display_name"] == "Qwen (Alibaba)" and got["Qwen"]["model_count"] == 2
    assert got["meta-llama"]["downloads"] == int(1000 + 1000 * 2.718281828459045 ** (-0.693 * 365 / 60))


def test_trending_rank_is_source_order(spark):
    rows = [("a/x", 5, 2, "2025-05-30T00:00:00Z", None, None, 9.0), ("solo", 50, 1, "bad", None, None, 8.0)]
    t = M.trending(hub(spark, rows), "2025-06-01").orderBy("rank").collect()
    assert [(r["rank"], r["model_name"], r["org"], r["days_ago"]) for r in t] == [(1, "x", "a", 2), (2, "solo", "—", None)]


def test_modality_champions(spark):
    rows = [("stabilityai/sd", 10, 1, None, "text-to-image", None, None),
            ("other/img", 5, 1, None, "text-to-image", None, None),
            ("hexgrad/k", 7, 1, None, "text-to-speech", None, None)]
    ch = S.modality_champions_from_hub(spark, hub(spark, rows))
    got = {r["label"]: r for r in M.modality_champions(ch).collect()}
    assert set(got) == {"Images", "Voice"} and got["Images"]["display_org"] == "Stability AI"


def test_coding_leaderboard(spark):
    res = spark.createDataFrame([
        ("cat", 0, "Claude + GPT agent", 70.0, "2025-01-01", 1.0, None, True),
        ("cat", 1, "o3 helper", None, None, None, False, None),
        ("cat", 2, "Unknown thing", 70.0, "2025-02-01", None, None, None)],
        "category string, src_pos int, " + S.LEADERBOARD_RESULT.simpleString()[len("struct<"):-1].replace(":", " "))
    t = M.coding_leaderboard(res).orderBy("rank").collect()
    assert [(r["name"], r["org"], r["resolved"], r["is_open"]) for r in t] == [
        ("Claude + GPT agent", "Anthropic", 70.0, True), ("Unknown thing", "Other", 70.0, False),
        ("o3 helper", "OpenAI", 0.0, False)]


def test_package_downloads(spark):
    p = spark.createDataFrame([("openai", 1, 10, 40), ("langchain", 1, 30, 90), ("newpkg", 1, 20, None)],
                              "package string, last_day long, last_week long, last_month long")
    got = [(r["package"], r["display_name"], r["company"]) for r in M.package_downloads(p).collect()]
    assert got == [("langchain", "LangChain", "Other"), ("newpkg", "newpkg", "Other"), ("openai", "OpenAI", "OpenAI")]


def test_number_duplicates_is_skew_safe_and_exact(spark):
    from rankmart.operators.dedup import number_duplicates
    df = spark.createDataFrame([("a", 1)] * 7 + [("b", 2)] * 2 + [("c", None)], "k string, v int")
    got = sorted((r["k"], r["dup_rank"]) for r in number_duplicates(df, chunk=3).collect())
    assert got == [("a", i) for i in range(1, 8)] + [("b", 1), ("b", 2), ("c", 1)]
    again = sorted((r["k"], r["dup_rank"]) for r in number_duplicates(df.repartition(5), chunk=2).collect())
    assert again == got


def test_insight_sentences(spark):
    hw = spark.createDataFrame([("NVIDIA",)] * 3 + [("Huawei",)] * 2 + [("Acme",)], S.ML_HARDWARE)
    assert M.chip_insight(hw).first()["insight"] == (
        "NVIDIA dominates with 3 of 6 registered AI chips (50%). The hidden story: China has 1 chip manufacturers "
        "(2 chips) vs 1 for the US (3 chips).")
    cl = clusters(spark, [("A", "Big Co", "China", None, None, 1.0, 1.0, "2500000", "1200.4"),
                          ("B", "Small Co", "United States of America", None, None, 1.0, 1.0, "1500", None)])
    assert M.gpu_insight(cl).first()["insight"] == (
        "2 GPU clusters across 2 countries. China leads with 1 clusters vs 1 for the US. Total power: 1,200 MW. "
        "Biggest investors by H100 equivalents: Big Co (2.5M), Small Co (2K).")
    rows = [("o/a", 0, 0, 2_000_000, "1", "1", None, None), ("o/b", 0, 0, 65_536, "1", "1", None, None)]
    assert M.context_insight(catalog_rows(spark, rows)).first()["insight"] == (
        "2 unique model families. The sweet spot is 32–128K tokens (1 models), but 1 models now exceed 1M tokens "
        "— led by 0 at 2.0M.")
    t = M.trending(hub(spark, [("a/x", 5, 2, "2025-05-30", None, None, 9.0),
                               ("b/y", 1500, 1, "2025-05-01", None, None, 8.0)]), "2025-06-01")
    assert M.trending_insight(t).first()["insight"] == "#2 y by b leads with 2K downloads. Freshest: x (2 days old)."


def test_capabilities_ties_keep_first_appearance(spark):
    rows = [("zeta/a", "a", 0, 1, "1", "1", ["image"], None), ("alpha/b", "b", 0, 1, "1", "1", None, None)]
    got = [r["org"] for r in M.capabilities(catalog_rows(spark, rows)).orderBy("rank").collect()]
    assert got == ["zeta", "alpha"]


def test_leaderboard_nan_is_missing(spark):
    rows = [("m", "A", BENCH_OF[c], 0.5, "2025-01-01") for c in CATS] + [("m", "A", "WeirdML", float("nan"), "x")]
    rows += [("m", "B", BENCH_OF[c], 0.4, "2025-01-01") for c in CATS]
    mat = {r["model_group"]: r for r in M.leaderboard_matrix(bench_rows(spark, rows)).collect()}
    assert mat["A"]["Code"] == pytest.approx(50.0)


def test_flagship_cutoff_uses_as_of_time(spark):
    rows = spark.createDataFrame([("X Pro", dt.date(2024, 12, 1)), ("Y", dt.date(2024, 12, 2))],
                                 "model string, date date")
    assert {r["model"] for r in M.flagship(rows, "2025-06-01 12:00:00").collect()} == {"Y"}
    assert {r["model"] for r in M.flagship(rows, "2025-06-01").collect()} == {"X Pro", "Y"}
    # month-end clamp: 2025-08-31 minus 6 months is 2025-02-28
    clamp = spark.createDataFrame([("Z", dt.date(2025, 2, 28)), ("W", dt.date(2025, 2, 27))], "model string, date date")
    assert {r["model"] for r in M.flagship(clamp, "2025-08-31").collect()} == {"Z"}


def test_flagship_ties_follow_source_order(spark, tmp_dir):
    import os
    d = os.path.join(tmp_dir, "notable")
    os.makedirs(d)
    with open(os.path.join(d, "n.csv"), "w") as f:
        f.write("Model,Organization,Publication date,Training compute (FLOP),Parameters\n"
                "Zeta Pro,OpenAI,2025-05-01,,\nAlpha Pro (beta),OpenAI,2025-05-01,,\n")
    notable = S.read_csv(spark, d, S.NOTABLE_MODELS, with_order=True)
    tl = M.timeline(notable)
    # one family ("Gem"), same tier and date; the file's first row sorts last by name
    same = tl.withColumn("model", F.when(F.col("model") == "Zeta Pro", F.lit("Gem Pro (z)"))
                                   .otherwise(F.lit("Gem Pro (a)")))
    kept = [r["model"] for r in M.flagship(same, "2025-06-01").collect()]
    assert kept == ["Gem Pro (z)"]        # first in the file wins the tie, not the smaller name
    assert [r["model"] for r in M.flagship(same.drop("src_order"), "2025-06-01").collect()] == ["Gem Pro (a)"]
