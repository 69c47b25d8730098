"""Readers for landed files (S1-S12) on files written to a scratch folder."""

import json
import os

import pytest

from rankmart.sources import feeds as S


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_nan_blank_text(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bench", "scores.csv")
    write(p, "model,model_group,benchmark,performance,date\n"
             "a,A,WeirdML,0.5,2025-01-01\nb,B,WeirdML,NaN,2025-01-02\nc,C,WeirdML,,2025-01-03\n"
             "d,D,WeirdML,oops,2025-01-04\n")
    rows = S.read_csv(spark, os.path.dirname(p), S.BENCH_SCORES).orderBy("model").collect()
    assert [r["performance"] for r in rows] == [0.5, None, None, None]


def test_catalog_positions(spark, tmp_dir):
    p = os.path.join(tmp_dir, "or", "models.json")
    write(p, json.dumps({"data": [
        {"id": "openai/a", "name": "A", "context_length": 10, "pricing": {"prompt": "0.1", "completion": "0.2"},
         "architecture": {"input_modalities": ["text"], "output_modalities": ["text"]}},
        {"id": "google/b", "pricing": {}, "architecture": None}]}))
    rows = S.read_catalog(spark, p).orderBy("src_pos").collect()
    assert [(r["src_pos"], r["id"]) for r in rows] == [(0, "openai/a"), (1, "google/b")]
    assert rows[0]["pricing"]["completion"] == "0.2" and rows[1]["architecture"] is None


def test_hub_models_and_top(spark, tmp_dir):
    p = os.path.join(tmp_dir, "hub", "top.json")
    write(p, json.dumps([{"id": f"o/m{i}", "downloads": i, "likes": 0, "pipeline_tag": "text-generation"}
                         for i in range(5)] + [{"id": "o/img", "downloads": 99, "pipeline_tag": "text-to-image"}]))
    hub = S.read_hub_models(spark, p)
    top = S.hub_top(hub, "downloads", 2).orderBy("rank").collect()
    assert [r["id"] for r in top] == ["o/m4", "o/m3"]


def page(cats):
    return ('<html><body><script id="leaderboard-data" type="application/json">\n'
            + json.dumps(cats) + "\n</script></body></html>")


def test_leaderboard_page_named_or_first(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "p1", "index.html")
    write(p1, page([{"name": "full", "results": [{"name": "x", "resolved": 1.0}]},
                    {"name": "bash-only", "results": [{"name": "A", "resolved": 50.0, "os_model": True},
                                                      {"name": "B", "resolved": None}]}]))
    rows = S.read_leaderboard_page(spark, p1).orderBy("src_pos").collect()
    assert [(r["category"], r["name"]) for r in rows] == [("bash-only", "A"), ("bash-only", "B")]
    p2 = os.path.join(tmp_dir, "p2", "index.html")
    write(p2, page([{"name": "lite", "results": [{"name": "L", "resolved": 10.0}]}]))
    assert [r["category"] for r in S.read_leaderboard_page(spark, p2).collect()] == ["lite"]
    p3 = os.path.join(tmp_dir, "p3", "index.html")
    write(p3, "<html>no data</html>")
    with pytest.raises(RuntimeError):
        S.require_rows(S.read_leaderboard_page(spark, p3), "coding leaderboard")


def test_package_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "pypi")
    write(os.path.join(d, "openai.json"), json.dumps({"package": "openai", "data": {"last_day": 1, "last_week": 7,
                                                                                   "last_month": 30}}))
    write(os.path.join(d, "anthropic.json"), json.dumps({"data": {"last_week": 5}}))
    write(os.path.join(d, "broken.json"), "{not json")
    got = {r["package"]: r for r in S.read_package_downloads(spark, d).collect()}
    assert set(got) == {"openai", "anthropic"}
    assert got["anthropic"]["last_week"] == 5 and got["anthropic"]["last_day"] == 0


def test_latest_dated_file(spark, tmp_dir):
    from pyspark.sql import types as T
    d = os.path.join(tmp_dir, "arena")
    schema = T.StructType([T.StructField("Model", T.StringType()), T.StructField("Arena Score", T.DoubleType())])
    write(os.path.join(d, "leaderboard_table_20240101.csv"), "Model,Arena Score\nold,1\n")
    write(os.path.join(d, "leaderboard_table_20250301.csv"), "Model,Arena Score\nnew,2\nnewer,3\n")
    write(os.path.join(d, "notes.csv"), "Model,Arena Score\nnoise,9\n")
    rows = S.read_latest_dated_csv(spark, d, schema).collect()
    assert sorted(r["Model"] for r in rows) == ["new", "newer"]
    assert {r["file_stamp"] for r in rows} == {"20250301"}


def test_mart_sink_snapshots(spark, tmp_dir):
    from rankmart.sources.sinks import read_mart, write_mart
    path = os.path.join(tmp_dir, "mart")
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    write_mart(a, path, "2025-06-01")
    write_mart(spark.createDataFrame([("y", 2)], "k string, v int"), path, "2025-06-02")
    write_mart(spark.createDataFrame([("z", 3)], "k string, v int"), path, "2025-06-02")  # rerun: replaced
    assert sorted(r["k"] for r in read_mart(spark, path).collect()) == ["z"]
    assert sorted(r["k"] for r in read_mart(spark, path, "2025-06-01").collect()) == ["x"]


def test_csv_source_order_across_files_and_splits(spark, tmp_dir):
    d = os.path.join(tmp_dir, "hw")
    write(os.path.join(d, "b.csv"), "Manufacturer\n" + "".join(f"b{i:05d}\n" for i in range(3000)))
    write(os.path.join(d, "a.csv"), "Manufacturer\n" + "".join(f"a{i:05d}\n" for i in range(20)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # several splits per file
    try:
        df = S.read_csv(spark, d, S.ML_HARDWARE, with_order=True)
        names = [r[0] for r in df.orderBy("src_order").select("Manufacturer").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == [f"a{i:05d}" for i in range(20)] + [f"b{i:05d}" for i in range(3000)]
