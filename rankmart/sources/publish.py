"""Atomic publication of one refresh (S13): staged writes, one commit record, readers that resolve through it.

    <root>/data/<version>-<writer>/<mart>/...   staged Parquet, invisible until committed
    <root>/commits/<version>.json               the marts of a version: path, schema, rows

A version's marts are written to a folder of their own, in any order and with any retries. One small file, created
whole or not at all, then publishes all of them at once; until it is there readers see the version before. Two writers that
prepare the same version: one's record is created, the other gets ``Conflict`` and its staged files stay invisible. A
refresh that fails or is aborted leaves only staged files, which ``clean`` removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rankmart.sources.files import Store


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Refresh:
    """One version in preparation. ``put`` stages a mart, ``commit`` publishes all of them, ``abort`` gives them up; as a
    context manager it commits at the end of the block and aborts on an error."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.root = self.store.root
        newest = newest_version(spark, root)
        self.version = (0 if newest is None else newest + 1) if version is None else int(version)
        self.folder = f"{self.root}/data/{self.version:012d}-{uuid.uuid4().hex}"
        self.marts: dict[str, dict] = {}

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a mart's rows into the staged version."""
        path = f"{self.folder}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.add(name, path, df.schema)

    def add(self, name: str, path: str, schema: StructType) -> str:
        """Count a mart that is already written (below this version's folder) in the version."""
        self.marts[name] = {"path": path.removeprefix(f"{self.root}/"), "schema": schema.jsonValue()}
        return path

    def commit(self, note: str = "") -> int:
        record = json.dumps({"version": self.version, "note": note, "marts": self.marts}, sort_keys=True)
        if not self.store.create_text(f"{self.root}/commits/{self.version:012d}.json", record):
            raise Conflict(f"version {self.version} of {self.root} is committed already")
        return self.version

    def abort(self) -> None:
        self.store.delete(self.folder)

    def __enter__(self) -> Refresh:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    return [int(n.removesuffix(".json")) for n in Store(spark, root).names(f"{root.rstrip('/')}/commits") if n.endswith(".json")]


def newest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    return max((v for v in versions(spark, root) if below is None or v < below), default=None)


class Published:
    """The marts of one committed version; all reads through one object see the same version."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        store = Store(spark, root)
        self.spark, self.root = spark, store.root
        self.version = newest_version(spark, root) if version is None else int(version)
        if self.version is None:
            raise RuntimeError(f"nothing is published in {root}")
        self.record = json.loads(store.read_text(f"{self.root}/commits/{self.version:012d}.json"))

    @property
    def marts(self) -> list[str]:
        return sorted(self.record["marts"])

    def read(self, name: str) -> DataFrame:
        mart = self.record["marts"][name]
        return self.spark.read.schema(StructType.fromJson(mart["schema"])).parquet(f"{self.root}/{mart['path']}")


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the data of versions older than the newest ``keep``, and staged data of committed versions that lost.

    Folders of versions above the newest commit may be in preparation and stay; an aborted refresh has removed its own."""
    store = Store(spark, root)
    root = store.root
    committed = versions(spark, root)
    if not committed:
        return []
    kept = {m["path"].split("/")[1] for v in committed[-keep:] for m in Published(spark, root, v).record["marts"].values()}
    gone = [n for n in store.names(f"{root}/data") if n not in kept and int(n.split("-")[0]) <= committed[-1]]
    for v in committed[:-keep]:
        store.delete(f"{root}/commits/{v:012d}.json")
    for n in gone:
        store.delete(f"{root}/data/{n}")
    return gone
