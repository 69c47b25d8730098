"""Incremental landing of snapshot files.

A dashboard refreshes on timers; here newly landed files are picked up by a
Structured Streaming file source and each micro-batch rebuilds the marts
that read them. No streaming state is kept: every batch appends snapshots
to a table and the marts re-read the table (the newest snapshot wins).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankmart.session import checkpoint_dir
from rankmart.sources.manifest import batch_files, record


def start_refresh(spark: SparkSession, landing_dir: str, schema: StructType, snapshot_table: str,
                  source: str, fmt: str = "json", rebuild: Callable[[SparkSession, DataFrame], None] | None = None,
                  available_now: bool = True, interval: str = "5 minutes", checkpoint: str | None = None,
                  options: dict | None = None, manifest: str | None = None):
    """Start the landing stream; returns the StreamingQuery.

    * new files in ``landing_dir`` are read with an explicit schema;
    * each batch is tagged with ``source`` and its fetch time (the file's
      modification time) and written as Parquet to ``snapshot_table``,
      partitioned by source and batch id (a replayed batch overwrites only
      its own partition, so the table never holds a batch twice);
    * ``manifest`` names a table that gets one row per landed file of the batch, for readers that want
      the newest landing's files only (see ``rankmart.sources.manifest``);
    * ``rebuild(spark, snapshots)`` then recomputes the marts from the whole
      snapshot table (``rankmart.streaming.incremental`` has marts that merge the batch instead).

    ``available_now`` processes what is there and stops (a scheduled job);
    otherwise it polls every ``interval`` (the 5-minute timer). The stream's
    checkpoint lives under the cluster's shared checkpoint folder, so a
    restarted driver resumes exactly after the last committed batch.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/refresh-{source}"
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    stream = reader.load(landing_dir).select(
        "*",
        F.lit(source).alias("source"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
        F.col("_metadata.file_name").alias("payload_file"),
        *([F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_size"),
                    F.col("_metadata.file_modification_time")).alias("_metadata")] if manifest else []))

    def batch(df: DataFrame, epoch_id: int) -> None:
        # A replayed epoch (after a failure) rewrites its own partition instead of
        # appending its rows a second time: the landing is idempotent per batch.
        if manifest is not None:
            record(batch_files(df), manifest, int(epoch_id))
            df = df.drop("_metadata")
        (df.withColumn("batch_id", F.lit(int(epoch_id)).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("source", "batch_id").parquet(snapshot_table))
        if rebuild is not None:
            rebuild(spark, spark.read.parquet(snapshot_table))

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def stream_refresh_status(spark: SparkSession, snapshot_table: str, schema: StructType, status_table: str,
                          available_now: bool = True, interval: str = "5 minutes", checkpoint: str | None = None):
    """Keep a refresh-status table current from the snapshot table ``start_refresh`` writes.

    A file stream over the snapshot table feeds a running aggregate per
    source (newest ``fetched_at``, landed rows). Its state is one row per
    source, so it stays small however many snapshots arrive; each micro-batch
    rewrites ``status_table`` with the complete result.
    ``schema`` is the snapshot rows' schema including ``source``,
    ``fetched_at`` and ``batch_id``.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/refresh-status"
    snaps = spark.readStream.schema(schema).parquet(snapshot_table)
    status = snaps.groupBy("source").agg(F.max("fetched_at").alias("last_fetched"),
                                         F.count(F.lit(1)).alias("rows_landed"))

    def batch(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(status_table)

    w = status.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
