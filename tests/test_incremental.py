"""Marts kept by merging batches (T3), and freshness by event-time timers."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankmart.operators.rank import rank_matrix, zscore_scores
from rankmart.sources.publish import Published, newest_version, versions
from rankmart.streaming.freshness import ends, start_freshness, transitions
from rankmart.streaming.incremental import State, decayed, leaderboard, merge_decayed, merge_leaderboard, start_incremental

CATS = ["a", "b", "c"]


def cells(rng, n):
    return [(rng.choice([None, *[f"e{i}" for i in range(12)]]), rng.choice([None, *CATS]), rng.choice([None, round(rng.uniform(-5, 90), 3)])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_leaderboard_is_the_one_shot_one(spark, tmp_dir, seed):
    rng = random.Random(seed)
    batches = [cells(rng, n) for n in (25, 1, 60, 40)]
    schema = "entity string, category string, score double"
    state = State(spark, tmp_dir)
    for epoch, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        assert state.merge(epoch, lambda before: merge_leaderboard(df, before, 2))
        got = [tuple(r) for r in leaderboard(state.read(), CATS, 2, 6, 100.0).select("rank", "entity", F.round("avg_z", 6), *CATS).collect()]
        every = spark.createDataFrame([r for b in batches[:epoch + 1] for r in b], schema)
        want = rank_matrix(zscore_scores(every, "entity", "category", "score", 2, 3), "entity", "category", CATS, "score", 6, 100.0)
        assert got == [tuple(r) for r in want.select("rank", "entity", F.round("avg_z", 6), *CATS).collect()]


def test_merged_decay_is_the_one_shot_one(spark, tmp_dir):
    rng, day = random.Random(4), dt.date(2024, 1, 1)
    rows = [(rng.choice(["x", "y", None]), rng.uniform(0, 1000), rng.choice([None, day + dt.timedelta(days=rng.randint(0, 90))])) for _ in range(200)]
    state, k, half = State(spark, tmp_dir), 0.693, 60.0
    for epoch in range(4):  # later batches hold older and newer days
        df = spark.createDataFrame(rows[epoch * 50:epoch * 50 + 50], "key string, value double, date date")
        state.merge(epoch, lambda before: merge_decayed(df, before, k, half))
    as_of = dt.date(2024, 6, 1)
    want = {}
    for key, value, date in rows:
        age = 365 if date is None else (as_of - date).days
        t, n = want.get(key, (0.0, 0))
        want[key] = (t + value * math.exp(-k * age / half), n + 1)
    got = {r["key"]: (r["total"], r["count"]) for r in decayed(state.read(), str(as_of), k, half, 365).collect()}
    assert got == {key: (int(t), n) for key, (t, n) in want.items()}
    with pytest.raises(Exception, match="newer than the day"):
        decayed(state.read(), "2024-01-05", k, half, 365).collect()


def test_replayed_epochs_count_once(spark, tmp_dir):
    df = spark.createDataFrame([("x", 1.0, dt.date(2024, 1, 1))], "key string, value double, date date")
    state = State(spark, tmp_dir)
    merge = lambda before: merge_decayed(df, before, 0.693, 60.0)
    assert state.merge(0, merge) and state.merge(1, merge)
    assert not state.merge(1, merge) and not state.merge(0, merge)  # replays
    with pytest.raises(RuntimeError, match="boom"):
        state.merge(2, lambda before: (_ for _ in ()).throw(RuntimeError("boom")))
    assert newest_version(spark, tmp_dir) == 1 and state.merge(2, merge)
    assert state.read().read("sums").first()["n"] == 3 and versions(spark, tmp_dir) == [1, 2]  # old versions are removed


def test_stream_of_two_marts(spark, tmp_dir):
    schema = "entity string, category string, score double"
    rng = random.Random(9)
    every = []
    parts = {"board": (lambda df: df, lambda df, before: merge_leaderboard(df, before, 2)),
             "sums": (lambda df: df.select(F.col("category").alias("key"), F.coalesce("score", F.lit(0.0)).alias("value"), F.lit(None).cast("date").alias("date")),
                      lambda df, before: merge_decayed(df, before, 0.693, 60.0))}
    for batch in range(3):
        rows = cells(rng, 30)
        every += rows
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_dir}/landed")
        start_incremental(spark.readStream.schema(schema).parquet(f"{tmp_dir}/landed"), parts, f"{tmp_dir}/state", "t", checkpoint=f"{tmp_dir}/c").awaitTermination(120)
    state = Published(spark, f"{tmp_dir}/state")
    assert state.marts == ["board_cells", "board_stats", "sums_sums"]
    assert {r["key"]: r["n"] for r in state.read("sums_sums").collect()} == {c: sum(r[1] == c for r in every) for c in [None, *CATS]}


# ------------------------------------------------------------------------------------ freshness

def plain(rows, ttls):
    """Transitions of (source, second) snapshots, and the last snapshot of each source."""
    out, last = [], {}
    for source, t in sorted(set(rows)):
        if source not in ttls:
            continue
        before = last.get(source)
        if before is not None and t - before >= ttls[source]:
            out.append((source, before + ttls[source], "stale"))
        if before is None or t - before >= ttls[source]:
            out.append((source, t, "fresh"))
        last[source] = t
    return out, last


def stamp(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_stream_gives_the_plain_transitions(spark, tmp_dir):
    rng, ttls = random.Random(5), {"a": 60, "b": 600}
    rows = [(rng.choice(["a", "b", "other"]), rng.randint(0, 20_000)) for _ in range(400)]
    rows += [("a", 30_000), ("b", 29_000)]
    for lo, hi in ((0, 4000), (4000, 9000), (9000, 20_001), (20_001, 40_000)):
        some = [(s, stamp(t)) for s, t in rows if lo <= t < hi]
        spark.createDataFrame(some, "source string, fetched_at timestamp_ntz").write.mode("append").parquet(f"{tmp_dir}/in")
        stream = spark.readStream.schema("source string, fetched_at timestamp_ntz").parquet(f"{tmp_dir}/in")
        start_freshness(stream, ttls, f"{tmp_dir}/out", f"{tmp_dir}/c").awaitTermination(120)
    got = sorted((r["source"], r["at"], r["state"]) for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    want, last = plain(rows, ttls)
    ended = [(s, stamp(t), x) for s, t, x in want]
    # b's last snapshot is over its TTL when a's arrives: its timer fires without a row of its own
    assert got == sorted(ended + [("b", stamp(last["b"] + 600), "stale")])


def test_late_rows_and_equal_times_change_nothing():
    minute = 60_000_000
    rows, last, stale = transitions("s", [0, 0, 10, minute + 10], None, minute, False)
    assert [r[2] for r in rows] == ["fresh", "stale", "fresh"] and (last, stale) == (minute + 10, False)
    assert transitions("s", [5], last, minute, False) == ([], last, False)
    assert [r[2] for r in transitions("s", [5 * minute], last, minute, True)[0]] == ["fresh"]  # the timer has reported it stale


def test_reduction_keeps_the_transitions():
    rng = random.Random(7)
    times = sorted(rng.randint(0, 50_000) for _ in range(3000))
    pdf = pd.DataFrame({"source": "a", "fetched_at": [pd.Timestamp(stamp(t)) for t in times]})
    few = pd.concat(ends(iter([pdf, pdf.head(0)]), {"a": 40}))
    seconds = sorted(int((t - pd.Timestamp(2024, 1, 1)).total_seconds()) for t in few["fetched_at"])
    assert plain([("a", t) for t in seconds], {"a": 40}) == plain([("a", t) for t in times], {"a": 40}) and len(few) < len(pdf)
    assert list(ends(iter([pd.DataFrame({"source": ["z", "a"], "fetched_at": [pd.Timestamp(0), pd.NaT]})]), {"a": 1})) == []
