"""Manifests of landed files (S11, X22) and atomic publication."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmart.plans.build import build_all, build_published
from rankmart.plans.landing import land_by_day, newest_landing_pages
from rankmart.sources import feeds as S
from rankmart.sources.manifest import (
    batch_files, list_files, manifest_of, newest_landing, newest_of_feed, newest_paths, package_of_name, read_manifest, record,
)
from rankmart.sources.publish import Conflict, Published, Refresh, clean, versions
from rankmart.streaming import start_refresh

SF = "/root/testdata/sf0.001"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


# ------------------------------------------------------------------------------------ manifest

def test_only_the_newest_folder_is_read(spark):
    df = newest_landing_pages(spark, SF)
    read = df.inputFiles()
    stamps = {p.split("/snapshot=")[1].split("/")[0] for p in read}
    assert len(stamps) == 1 and stamps == {r["stamp"] for r in df.select("stamp").distinct().collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "InMemoryFileIndex(1 paths)" in plan


def test_manifest_grows_by_batches(spark, tmp_dir):
    files = read_manifest(spark, land_by_day(spark, SF, tmp_dir))
    by = {r["stamp"][:6]: r["count"] for r in files.groupBy("stamp").count().collect()}
    assert set(by) == {"202403"} and files.select("path").distinct().count() == files.count()
    assert {r["batch"] for r in spark.read.parquet(f"{tmp_dir}/manifest").select("batch").distinct().collect()} == {0, 1, 2}
    record(list_files(spark, f"{tmp_dir}/pages").limit(1), f"{tmp_dir}/manifest", 2)  # a batch recorded again replaces itself
    assert spark.read.parquet(f"{tmp_dir}/manifest").filter("batch = 2").count() == 1


def test_old_files_are_not_opened(spark, tmp_dir):
    """Files that can't be parsed do no harm in an older landing."""
    write(f"{tmp_dir}/feed/snapshot=2025-01-01/a.csv", "Other\nx\n")
    write(f"{tmp_dir}/feed/snapshot=2025-02-01/b.csv", "Manufacturer\nNVIDIA\nAMD\n")
    write(f"{tmp_dir}/feed/late-but-unstamped.csv", "Other\ny\n")
    paths = newest_of_feed(spark, f"{tmp_dir}/feed")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["snapshot=2025-02-01"]
    assert sorted(r[0] for r in S.read_csv(spark, paths, S.ML_HARDWARE).collect()) == ["AMD", "NVIDIA"]


def test_newest_dated_file(spark, tmp_dir):
    for stamp, score in (("20240101", 1), ("20250301", 2), ("20231231", 3)):
        write(f"{tmp_dir}/arena/leaderboard_table_{stamp}.csv", f"Model,Score\nm{score},{score}\n")
    write(f"{tmp_dir}/arena/leaderboard_table_20990101.csv.bak", "broken")
    schema = T.StructType([T.StructField("Model", T.StringType()), T.StructField("Score", T.DoubleType())])
    df = S.read_latest_dated_csv(spark, f"{tmp_dir}/arena", schema)
    assert [tuple(r) for r in df.collect()] == [("m2", 2.0, "leaderboard_table_20250301.csv", "20250301")]
    assert len(df.inputFiles()) == 1
    os.makedirs(f"{tmp_dir}/none")
    write(f"{tmp_dir}/none/other.csv", "a\n")
    empty = S.read_latest_dated_csv(spark, f"{tmp_dir}/none", schema)
    assert empty.columns == df.columns and empty.count() == 0


def test_newest_per_package(spark):
    at = dt.datetime(2025, 6, 1)
    rows = [(f"/l/{n}", n, "", "", n, 1, at + dt.timedelta(days=d)) for n, d in (("openai.1.json", 0), ("openai.2.json", 1), ("torch.json", -9))]
    files = spark.createDataFrame(rows, "path string, name string, folder string, stamp string, landing string, bytes long, landed_at timestamp_ntz")
    assert sorted(r["name"] for r in newest_landing(files, package_of_name()).collect()) == ["openai.2.json", "torch.json"]
    assert newest_paths(files) == ["/l/openai.2.json"]


def test_landing_stream_keeps_a_manifest(spark, tmp_dir):
    for i in range(3):
        write(f"{tmp_dir}/landing/pypi/p{i}.json", json.dumps({"package": f"p{i}"}))
    known = manifest_of(f"{tmp_dir}/landing", "pypi")
    schema = T.StructType([T.StructField("package", T.StringType())])
    go = lambda: start_refresh(spark, f"{tmp_dir}/landing/pypi", schema, f"{tmp_dir}/snaps", "pypi", checkpoint=f"{tmp_dir}/c",
                               manifest=known).awaitTermination(120)
    go()
    assert sorted(r["name"] for r in read_manifest(spark, known).collect()) == ["p0.json", "p1.json", "p2.json"]
    write(f"{tmp_dir}/landing/pypi/p9.json", json.dumps({"package": "p9"}))
    go()
    files = read_manifest(spark, known)
    assert files.count() == 4 and all(r["bytes"] > 0 for r in files.collect())
    assert "_metadata" not in spark.read.parquet(f"{tmp_dir}/snaps").columns


def test_batch_files_of_a_scan(spark, tmp_dir):
    spark.range(100).repartition(3).write.parquet(f"{tmp_dir}/t")
    assert batch_files(spark.read.parquet(f"{tmp_dir}/t")).count() == 3


# ------------------------------------------------------------------------------------ publication

def test_readers_see_whole_versions(spark, tmp_dir):
    root = f"{tmp_dir}/marts"
    with pytest.raises(RuntimeError, match="nothing is published"):
        Published(spark, root)
    with Refresh(spark, root) as r:
        r.put("a", spark.range(3))
        r.put("b", spark.range(4))
    first = Published(spark, root)
    second = Refresh(spark, root)
    second.put("a", spark.range(30))
    assert Published(spark, root).read("a").count() == 3  # staged, not committed
    second.put("b", spark.range(40))
    second.commit()
    assert [Published(spark, root).read(m).count() for m in ("a", "b")] == [30, 40]
    assert [first.read(m).count() for m in ("a", "b")] == [3, 4]  # a reader keeps its version


def test_failed_and_aborted_refreshes_leave_nothing_visible(spark, tmp_dir):
    root = f"{tmp_dir}/marts"
    with Refresh(spark, root) as r:
        r.put("a", spark.range(1))
    with pytest.raises(Exception, match="boom"):
        with Refresh(spark, root) as r:
            r.put("a", spark.range(2))
            r.put("b", spark.range(2).select(F.raise_error(F.lit("boom")).cast("long").alias("id")))
    assert versions(spark, root) == [0] and len(os.listdir(f"{root}/data")) == 1
    assert Published(spark, root).marts == ["a"]


def test_two_writers_of_one_version(spark, tmp_dir):
    root = f"{tmp_dir}/marts"
    x, y = Refresh(spark, root), Refresh(spark, root)
    x.put("a", spark.range(1))
    y.put("a", spark.range(2))
    x.commit()
    with pytest.raises(Conflict):
        y.commit()
    assert Published(spark, root).read("a").count() == 1
    z = Refresh(spark, root)
    z.put("a", spark.range(3))
    assert len(clean(spark, root, keep=1)) == 1  # the loser's files; the version in preparation stays
    z.commit()
    assert Published(spark, root).read("a").count() == 3


def test_clean_keeps_the_newest(spark, tmp_dir):
    root = f"{tmp_dir}/marts"
    for n in (1, 2, 3):
        with Refresh(spark, root) as r:
            r.put("a", spark.range(n))
    clean(spark, root, keep=2)
    assert versions(spark, root) == [1, 2] and Published(spark, root, 1).read("a").count() == 2


def test_empty_mart_keeps_its_schema(spark, tmp_dir):
    with Refresh(spark, tmp_dir) as r:
        r.put("none", spark.range(0).select(F.col("id").alias("x"), F.lit("y").alias("y")), ["y"])
    assert Published(spark, tmp_dir).read("none").dtypes == [("x", "bigint"), ("y", "string")]


def test_build_published(spark, tmp_dir):
    land, root = f"{tmp_dir}/landing", f"{tmp_dir}/marts"
    write(f"{land}/ml_hardware/snapshot=2025-05-01/h.csv", "Manufacturer\nOld\n")
    write(f"{land}/ml_hardware/snapshot=2025-06-01/h.csv", "Manufacturer\nNVIDIA\nAMD\nAMD\n")
    assert build_published(spark, land, root, "2025-06-01 00:00:00") == 0
    write(f"{land}/ml_hardware/snapshot=2025-07-01/h.csv", "Manufacturer\nNVIDIA\n")
    assert build_published(spark, land, root, "2025-07-01 00:00:00") == 1
    assert [r["manufacturer"] for r in Published(spark, root).read("chips").collect()] == ["NVIDIA"]
    assert {r["manufacturer"] for r in Published(spark, root, 0).read("chips").collect()} == {"NVIDIA", "AMD"}
    written = build_all(spark, land, f"{tmp_dir}/plain", "2025-07-01 00:00:00")
    assert set(Published(spark, root).marts) == set(written)
