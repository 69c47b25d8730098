"""Quarantine scan (S10, U4): one pass over many files, good payloads apart from files that can't be used.

Each file holds one JSON document. A single scan reads and judges every file and writes it to one of two partitions of a
table, so the good rows, the quarantine list and the counts of both come from the same reading: a file can't be counted
good in one place and bad in another, and nothing is opened or parsed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart.sources.variant import field

GOOD = "good"
TASK_FILES = 1000  # small files of a task, at least


def reason(text: Column, doc: Column, required: dict[str, str]) -> Column:
    """Why a document can't be used, or null: ``empty``, ``truncated`` (starts like JSON and doesn't end like it), ``not json``,
    ``not an object``, ``missing <path>``, ``wrong type <path>``. ``required`` maps paths to types."""
    bare = F.trim(F.regexp_replace(text, r"^\s+", ""))
    opened, closed = F.substring(bare, 1, 1), F.substring(F.rtrim(bare, F.lit(" \t\r\n")), -1, 1)
    cut = ((opened == "{") & (closed != "}")) | ((opened == "[") & (closed != "]"))
    out = (F.when(bare == "", "empty").when(doc.isNull() & cut, "truncated").when(doc.isNull(), "not json")
            .when(F.try_variant_get(doc, "$", "map<string,variant>").isNull(), "not an object"))
    for path, kind in required.items():
        there = F.try_variant_get(doc, f"$.{path}", "variant")
        there = there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(True))
        out = out.when(~there, f"missing {path}").when(field(doc, path, kind).isNull(), f"wrong type {path}")
    return out


def scan(spark: SparkSession, path: str | list[str], required: dict[str, str], out: str) -> tuple[DataFrame, DataFrame]:
    """Read every file below ``path`` once and split it: (good, quarantined).

    ``good`` has file, folder columns of the layout and ``doc`` (a variant); ``quarantined`` has file, reason, bytes, head
    (the first 80 characters). Both are read from the table written to ``out``.
    """
    files = spark.read.text(path, wholetext=True)
    layout = [c for c in files.columns if c != "value"]
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value", *layout,
                        F.try_parse_json("value").alias("doc"))
    judged = rows.withColumn("reason", reason(F.col("value"), F.col("doc"), required))
    judged = judged.select("file", "bytes", *layout, F.when(F.col("reason").isNull(), F.col("value")).alias("value"), "reason",
                           F.when(F.col("reason").isNotNull(), F.substring("value", 1, 80)).alias("head"),
                           F.when(F.col("reason").isNull(), GOOD).otherwise("quarantined").alias("status"))
    names = files.inputFiles()
    # a partition of the scan holds a few dozen small files and would write two of its own: a task takes several of them
    judged.coalesce(max(4 * spark.sparkContext.defaultParallelism, len(names) // TASK_FILES)).write.mode("overwrite").partitionBy("status").parquet(out)
    # a scan has no row for a file of no bytes: these are what is listed and not in the table (the driver holds the listing anyway)
    listed = spark.createDataFrame([(f,) for f in names], "path string")
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    kinds = dict(judged.dtypes)
    folder = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).try_cast(kinds[c]).alias(c) for c in layout]
    seen = spark.read.schema(judged.schema).parquet(out).select(bare("file").alias("seen"))
    none = listed.join(seen, bare("path") == F.col("seen"), "left_anti").select(
        F.col("path").alias("file"), F.lit(0).cast("long").alias("bytes"), *folder, F.lit(None).cast("string").alias("value"),
        F.lit("empty").alias("reason"), F.lit("").alias("head"), F.lit("quarantined").alias("status"))
    none.write.mode("append").partitionBy("status").parquet(out)
    table = spark.read.schema(judged.schema).parquet(out)  # status is a folder: each side reads its own files
    good = table.filter(F.col("status") == GOOD).select("file", *layout, F.parse_json("value").alias("doc"))
    return good, table.filter(F.col("status") != GOOD).select("file", *layout, "reason", "bytes", "head")


def counts(spark: SparkSession, out: str) -> DataFrame:
    """Files and bytes per reason (``good`` for usable ones) of a scan's table."""
    table = spark.read.parquet(out)
    return table.groupBy(F.coalesce("reason", F.lit(GOOD)).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
