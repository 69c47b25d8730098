"""Small files and folders through the cluster's file system (any store Spark can reach)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """The Hadoop file system that holds a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, hidden ones left out; none if there is no such folder."""
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        return sorted(n for s in self._fs.listStatus(at) if not (n := s.getPath().getName()).startswith("."))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if another writer made it before."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        no_overwrite = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        no_overwrite[0] = options.NONE
        try:
            files.rename(draft, self._path(path), no_overwrite)  # NONE: fails if the target is there
            return True
        except Exception:
            self._fs.delete(draft, False)
            if self.exists(path):
                return False
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
