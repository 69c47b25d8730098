"""Mart sink (S13): one Parquet folder per mart, one partition per snapshot date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_mart(df: DataFrame, path: str, snapshot_date: str, partition_col: str = "snapshot_date") -> None:
    """Write (or rewrite) one snapshot partition of a mart.

    Dynamic partition overwrite replaces only this snapshot's folder, so a
    retried or repeated run is idempotent and older snapshots stay.
    """
    (df.withColumn(partition_col, F.lit(snapshot_date).cast("date"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).parquet(path))


def read_mart(spark: SparkSession, path: str, snapshot_date: str | None = None,
              partition_col: str = "snapshot_date") -> DataFrame:
    """A mart's rows, for one snapshot (partition-pruned) or the newest one."""
    df = spark.read.parquet(path)
    if snapshot_date is not None:
        return df.filter(F.col(partition_col) == F.lit(snapshot_date).cast("date"))
    newest = df.agg(F.max(partition_col).alias(partition_col))  # one row
    return df.join(F.broadcast(newest), partition_col, "left_semi")
