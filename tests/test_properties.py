"""Property tests: random small inputs against brute-force pandas statements of the same
semantics, and invariance under repartitioning."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.operators import bucket_counts, keep_first
from rankmart.plans import marts as M
from rankmart.sources import feeds as S

SETTINGS = settings(max_examples=int(__import__("os").environ.get("PROP_EXAMPLES", "8")), deadline=None, suppress_health_check=list(HealthCheck))
BENCHES = [bs[0] for bs in fixed.CATEGORY_MAP.values()] + ["OTIS Mock AIME 2024-2025", "Unlisted"]
CAT_OF = {b: c for c, bs in fixed.CATEGORY_MAP.items() for b in bs}

bench_row = st.tuples(st.sampled_from(["A", "B", "C", "D", "E", "F"]), st.sampled_from(BENCHES),
                      st.one_of(st.none(), st.floats(0, 1, allow_nan=False).map(lambda x: round(x, 3))))


def brute_leaderboard(rows, top=8):
    df = pd.DataFrame(rows, columns=["g", "b", "p"])
    df = df[df["b"].isin(CAT_OF)].assign(c=lambda d: d["b"].map(CAT_OF))
    best = df.groupby(["g", "c"])["p"].max().reset_index()
    n = best.groupby("g")["c"].count()
    q = best[best["g"].isin(n[n >= len(fixed.CATEGORY_MAP) - 1].index)].copy()
    stt = q.groupby("c")["p"].agg(["mean", "std"])
    q["z"] = [((r.p - stt.loc[r.c, "mean"]) / stt.loc[r.c, "std"]) if stt.loc[r.c, "std"] > 0 else 0.0
              for r in q.itertuples()]
    avg = q.groupby("g")["z"].mean().round(9)
    order = sorted(avg.index, key=lambda g: (math.isnan(avg[g]), -avg[g] if not math.isnan(avg[g]) else 0, g))[:top]
    out = []
    for i, g in enumerate(order, 1):
        cells = {c: q[(q.g == g) & (q.c == c)]["p"].max() * 100 for c in fixed.CATEGORY_MAP}
        out.append((i, g, round(avg[g], 6) if not math.isnan(avg[g]) else None,
                    tuple(None if pd.isna(v) else round(v, 6) for v in cells.values())))
    return out


@SETTINGS
@given(st.lists(bench_row, min_size=1, max_size=40))
def test_leaderboard_matches_brute_force(spark, rows):
    data = [("m", g, b, p, "2025-01-01") for g, b, p in rows]
    df = spark.createDataFrame(data, S.BENCH_SCORES)
    if not any(b in CAT_OF for _, b, _ in rows):
        return
    got = [(r["rank"], r["model_group"], None if r["avg_z"] is None else round(r["avg_z"], 6),
            tuple(None if r[c] is None else round(r[c], 6) for c in fixed.CATEGORY_MAP))
           for r in M.leaderboard_matrix(df.repartition(3)).orderBy("rank").collect()]
    assert got == brute_leaderboard(rows)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5), st.integers(0, 1000)), min_size=1, max_size=60))
def test_keep_first_one_row_per_key_and_partition_free(spark, rows):
    data = [(k, v, i) for i, (k, v, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, v int, pos int")
    order = [F.col("v").desc(), F.col("pos").asc()]
    a = sorted(tuple(r) for r in keep_first(df, "k", order).collect())
    b = sorted(tuple(r) for r in keep_first(df.repartition(4, "pos"), "k", order).collect())
    pdf = pd.DataFrame(data, columns=["k", "v", "pos"]).sort_values(["v", "pos"], ascending=[False, True])
    want = sorted(tuple(int(x) for x in r) for r in pdf.drop_duplicates("k").itertuples(index=False))
    assert a == b == want


@SETTINGS
@given(st.lists(st.integers(-5, 1_200_000), min_size=0, max_size=50))
def test_bucket_counts_sum_and_examples(spark, values):
    data = [(v, f"m{i}", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "ctx int, name string, pos int")
    got = bucket_counts(spark, df, "ctx", "name", fixed.CONTEXT_BUCKETS, F.col("pos").asc()).orderBy("ord").collect()
    for (lab, lo, hi), r in zip(fixed.CONTEXT_BUCKETS, got):
        inb = [(v, n, p) for v, n, p in data if v >= lo and (hi is None or v <= hi)]
        assert r["bucket"] == lab and r["count"] == len(inb)
        top = [n for v, n, p in sorted(inb, key=lambda x: (-x[0], x[2]))[:3]]
        assert r["examples"] == (", ".join(top) if top else "—")
    assert sum(r["count"] for r in got) == sum(1 for v in values if v >= 0)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a/x", "b/y", "c/z", "solo"]), st.integers(0, 10_000),
                          st.one_of(st.none(), st.dates(pd.Timestamp("2024-01-01").date(),
                                                        pd.Timestamp("2026-01-01").date()).map(str))),
                min_size=1, max_size=30))
def test_decayed_downloads_match_brute_force(spark, rows):
    data = [("f", i, mid, dl, 0, created, "text-generation", None, None) for i, (mid, dl, created) in enumerate(rows)]
    schema = "src_file string, src_pos int, " + S.HUB_MODEL.simpleString()[len("struct<"):-1].replace(":", " ")
    got = {r["org"]: (r["downloads"], r["model_count"]) for r in M.downloads(spark.createDataFrame(data, schema),
                                                                              "2025-06-01").collect()}
    as_of = pd.Timestamp("2025-06-01")
    acc = {}
    for mid, dl, created in rows:
        org = mid.split("/")[0] if "/" in mid else "community"
        if org in fixed.DOWNLOADS_EXCLUDED_ORGS:
            continue
        days = 365 if created is None else max((as_of - pd.Timestamp(created)).days, 0)
        s, n = acc.get(org, (0.0, 0))
        acc[org] = (s + dl * math.exp(-0.693 * days / 60), n + 1)
    want = {o: (int(round(s, 6)), n) for o, (s, n) in acc.items()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", "g3"]),
                          st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False))),
                min_size=1, max_size=80),
       st.sampled_from([2, 3, 7, 256]))
def test_group_median_exact(spark, rows, buckets):
    from rankmart.operators import group_median
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in group_median(df.repartition(3), "v", "g", buckets=buckets).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    want = pdf.groupby("g")["v"].median().to_dict()
    assert set(got) == set(want)
    for g in want:
        assert math.isclose(got[g], want[g], rel_tol=1e-12, abs_tol=1e-9)


names = st.sampled_from(["GPT-4", "gpt-4", " GPT-4 ", "Claude 3", "claude 3\t", "Gemini", "Llama 3", "o3-mini", None])


@SETTINGS
@given(st.lists(names, max_size=8), st.lists(names, max_size=8))
def test_append_missing_matches_brute_force(spark, a_names, b_names):
    from rankmart.operators import append_missing
    a = spark.createDataFrame([(n, "A") for n in a_names], "model string, src string")
    b = spark.createDataFrame([(n, "B", i) for i, n in enumerate(b_names)], "model string, src string, i int")
    got = sorted((r["model"] or "", r["src"]) for r in append_missing(a, b, "model", "model").collect())
    seen = {n.strip().lower() for n in a_names if n is not None}
    want = [(n or "", "A") for n in a_names] + [(n or "", "B") for n in b_names
                                                 if n is None or n.strip().lower() not in seen]
    assert got == sorted(want)


RULES = [(["gpt", "o3"], "OpenAI"), (["claude"], "Anthropic"), (["GPT-4"], "Never"), (["ll", "gem"], "Mixed")]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet="GPTgptClaude -4o3llmein", max_size=12)), max_size=12),
       st.sampled_from(["contains", "contains_ci", "prefix"]))
def test_classify_first_matches_brute_force(spark, values, mode):
    from rankmart.functions import classify_first

    def brute(v):
        if v is None:
            return "Other"
        for pats, label in RULES:
            for p in pats:
                hit = (p in v if mode == "contains" else p.lower() in v.lower() if mode == "contains_ci"
                       else v.startswith(p))
                if hit:
                    return label
        return "Other"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["c"] for r in df.select("i", classify_first("v", RULES, mode, "Other").alias("c")).orderBy("i").collect()]
    assert got == [brute(v) for v in values]
