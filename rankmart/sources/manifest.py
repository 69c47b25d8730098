"""Manifest of landed files (S11, X22, the newest-snapshot side of S1-S10).

A landing folder keeps every file that ever arrived. The manifest is a small Parquet table with one row per landed file,
written by the landing itself or from a metadata-only listing (no file is opened). Readers take the newest landing's
paths from it and give them to the scan, so a refresh opens the files of one landing however many lie beside them.

A landing is known by its stamp, the ``snapshot=<stamp>`` folder or the date in a dated file's name. Stamped landings
order by stamp and come after all others, which order by their newest file's landing time; without a stamp each write job
(the id that its part files share) or else each file is a landing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "path string, name string, folder string, stamp string, landing string, bytes long, landed_at timestamp_ntz"
MANY = 1000  # paths of one landing above which its folder is read instead, when it has one


def _described(path: Column, size: Column, at: Column, pattern: str | None) -> list[Column]:
    name = F.substring_index(path, "/", -1)
    folder = F.regexp_extract(path, r"^(.*/snapshot=[^/]+)/", 1)
    stamp = F.regexp_extract(path, r"/snapshot=([^/]+)/", 1)
    if pattern is not None:
        dated = F.regexp_extract(name, "^" + pattern + "$", 1)
        stamp = F.when(stamp != "", stamp).otherwise(dated)
    job = F.regexp_extract(name, r"^part-\d+-([0-9a-f-]{36})", 1)
    landing = F.when(stamp != "", stamp).when(job != "", job).otherwise(name)
    return [path.alias("path"), name.alias("name"), folder.alias("folder"), stamp.alias("stamp"), landing.alias("landing"),
            size.cast("long").alias("bytes"), at.cast("timestamp_ntz").alias("landed_at")]


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per file below ``path`` from the file listing alone; ``pattern`` has the stamp of dated names as group 1."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                  .select("path", "length", "modificationTime"))
    rows = found.select(*_described(F.col("path"), F.col("length"), F.col("modificationTime"), pattern))
    return rows if pattern is None else rows.filter(F.col("stamp") != "")


def batch_files(batch: DataFrame, pattern: str | None = None) -> DataFrame:
    """The same rows for the files that a streaming micro-batch (or any file scan) reads: one per file, not per row."""
    meta = batch.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"),
                        F.col("_metadata.file_modification_time").alias("t")).distinct()
    return meta.select(*_described(F.col("p"), F.col("n"), F.col("t"), pattern))


def record(files: DataFrame, manifest: str, batch: int) -> None:
    """Add a batch's files to the manifest; a batch recorded again replaces its own rows only."""
    (files.withColumn("batch", F.lit(int(batch)).cast("long")).coalesce(1).write.mode("overwrite")
          .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(manifest))


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """Landed files, each path once (a file seen by two batches counts as the later one saw it)."""
    rows = spark.read.schema(COLUMNS + ", batch long").parquet(manifest)
    last = F.max_by(F.struct(*[c.split()[0] for c in COLUMNS.split(", ") if c.split()[0] != "path"]), "batch").alias("f")
    return rows.groupBy("path").agg(last).select("path", "f.*")


def newest_landing(files: DataFrame, key: Column | None = None) -> DataFrame:
    """The files of the newest landing, overall or per ``key`` (an expression over a file's columns, e.g. the package in its
    name)."""
    by = F.lit(0) if key is None else key
    rows = files.withColumn("_key", by)
    age = F.struct("stamp", "at", "landing")
    landings = rows.groupBy("_key", "stamp", "landing").agg(F.max("landed_at").alias("at"))
    newest = landings.groupBy("_key").agg(F.max(age).alias("_new"))  # one row per key
    newest = newest.select("_key", F.col("_new.stamp").alias("stamp"), F.col("_new.landing").alias("landing"))
    return rows.join(newest, ["_key", "stamp", "landing"], "left_semi").drop("_key")


def newest_paths(files: DataFrame, key: Column | None = None) -> list[str]:
    """Paths to read for the newest landing: its folder where it has one of its own, else its files."""
    new = newest_landing(files, key).select(F.when(F.col("folder") != "", F.col("folder")).otherwise(F.col("path")).alias("p")).distinct()
    paths = sorted(r["p"] for r in new.limit(MANY + 1).collect())
    if len(paths) > MANY:
        raise ValueError(f"the newest landing has more than {MANY} separate files; land it in a snapshot=<stamp> folder")
    return paths


def newest_of_feed(spark: SparkSession, path: str, pattern: str | None = None, manifest: str | None = None,
                   key: Column | None = None) -> list[str]:
    """Paths of a feed's newest landing, from its manifest if it has one, else from the listing of its folder."""
    files = list_files(spark, path, pattern) if manifest is None else read_manifest(spark, manifest)
    return newest_paths(files, key)


def package_of_name() -> Column:
    """A file's package: its name up to the first dot; a part file stands for itself."""
    return F.when(F.col("name").startswith("part-"), F.col("name")).otherwise(F.regexp_extract("name", r"^([^.]+)", 1))


def manifest_of(landing: str, feed: str) -> str:
    """Where a landing folder keeps a feed's manifest."""
    return os.path.join(landing, "_manifest", feed)
