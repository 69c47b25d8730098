"""Snapshot freshness (T1), refresh status (T2) and the landing stream."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import types as T

from rankmart.streaming import last_refresh, latest_snapshot, start_refresh


def snaps(spark):
    return spark.createDataFrame([
        ("benchmarks", dt.datetime(2025, 6, 1, 0, 0), "a"),
        ("benchmarks", dt.datetime(2025, 6, 1, 23, 0), "b"),
        ("openrouter", dt.datetime(2025, 6, 1, 22, 0), "c")],
        "source string, fetched_at timestamp_ntz, payload string")


def test_latest_snapshot_fresh_and_stale(spark):
    ttls = {"benchmarks": 86400, "openrouter": 300}
    got = {r["source"]: r for r in latest_snapshot(snaps(spark), "2025-06-02 00:00:00", ttls).collect()}
    assert got["benchmarks"]["payload"] == "b" and got["benchmarks"]["is_fresh"] is True
    assert got["openrouter"]["is_fresh"] is False and got["openrouter"]["age_seconds"] == 7200.0


def test_latest_snapshot_missing_source_fails(spark):
    with pytest.raises(RuntimeError, match="swebench"):
        latest_snapshot(snaps(spark), "2025-06-02 00:00:00", {"benchmarks": 1}, require=["benchmarks", "swebench"])


def test_last_refresh_labels(spark):
    got = {r["source"]: r["status"] for r in last_refresh(spark, snaps(spark), ["benchmarks", "pypi"],
                                                          labels={"benchmarks": "Epoch"}).collect()}
    assert got == {"benchmarks": "Epoch  ·  Last refreshed: 2025-06-01 23:00 UTC", "pypi": "pypi  ·  Fetching..."}


def test_refresh_stream_available_now(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(land)
    for i in range(3):
        with open(os.path.join(land, f"snap{i}.json"), "w") as f:
            f.write(json.dumps({"package": f"p{i}", "last_week": i}) + "\n")
    table = os.path.join(tmp_dir, "snapshots")
    seen = []
    schema = T.StructType([T.StructField("package", T.StringType()), T.StructField("last_week", T.LongType())])
    q = start_refresh(spark, land, schema, table, "pypi",
                      rebuild=lambda s, df: seen.append(df.count()),
                      checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(table)
    assert out.count() == 3 and seen and seen[-1] == 3
    assert {r["source"] for r in out.select("source").collect()} == {"pypi"}
    # more files land: the restarted stream resumes after the committed batch
    with open(os.path.join(land, "snap9.json"), "w") as f:
        f.write(json.dumps({"package": "p9", "last_week": 9}) + "\n")
    q2 = start_refresh(spark, land, schema, table, "pypi", checkpoint=os.path.join(tmp_dir, "ckpt"))
    q2.awaitTermination(120)
    assert spark.read.parquet(table).count() == 4


def test_stream_refresh_status(spark, tmp_dir):
    from rankmart.streaming import stream_refresh_status
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(land)
    for i in range(2):
        with open(os.path.join(land, f"s{i}.json"), "w") as f:
            f.write(json.dumps({"package": f"p{i}", "last_week": i}) + "\n")
    table = os.path.join(tmp_dir, "snapshots")
    schema = T.StructType([T.StructField("package", T.StringType()), T.StructField("last_week", T.LongType())])
    start_refresh(spark, land, schema, table, "pypi", checkpoint=os.path.join(tmp_dir, "c1")).awaitTermination(120)
    snap_schema = T.StructType(schema.fields + [T.StructField("fetched_at", T.TimestampNTZType()),
                                                T.StructField("payload_file", T.StringType()),
                                                T.StructField("source", T.StringType()),
                                                T.StructField("batch_id", T.LongType())])
    status = os.path.join(tmp_dir, "status")
    stream_refresh_status(spark, table, snap_schema, status, checkpoint=os.path.join(tmp_dir, "c2")).awaitTermination(120)
    rows = spark.read.parquet(status).collect()
    assert [(r["source"], r["rows_landed"]) for r in rows] == [("pypi", 2)] and rows[0]["last_fetched"] is not None
