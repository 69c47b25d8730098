"""SparkSession settings used by the library, tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC clock (N10), ANSI casts (N3), AQE for
# runtime re-planning (coalesce small shuffles, split skewed join partitions).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


RUNTIME_CONF = {k: v for k, v in BASE_CONF.items() if k.startswith("spark.sql.")}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Apply the session-level SQL settings the jobs rely on (UTC clock, AQE) to a session
    built elsewhere (e.g. by a scheduler or a notebook)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:  # a session that refuses one would give other answers: let it raise
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "rankmart", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster ``master`` is left to spark-submit; locally it defaults to
    ``local[*]`` with as many shuffle partitions as cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not os.environ.get("SPARK_MASTER"):
        master = "local[*]"
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = os.cpu_count() or 8
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):  # core settings hold from the session's start
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local master gets a scratch folder (driver and executors are one process);
    any other master is an error, as executors would write to their own disks.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local SparkContext
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rankmart-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def sizing(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a run over ``input_bytes`` of Parquet on ``total_cores`` cores.

    * scan splits of ``target_partition_bytes`` (compressed), so a task's
      decoded batch stays well inside executor memory;
    * an initial shuffle width of at least 2 tasks per core and at least one
      partition per target size of input (AQE then coalesces small
      partitions to the advisory size and splits skewed ones);
    * the broadcast threshold is left at Spark's default: only sides measured
      under it at runtime are broadcast.

    At 100 TB on 1,000 executors x 8 cores this gives ~400k initial shuffle
    partitions of 256 MB, coalesced by AQE after each stage.
    """
    parts = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
