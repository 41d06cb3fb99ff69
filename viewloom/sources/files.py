"""File operations by Hadoop's file systems, for any path that Spark can open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    size: int


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def list(self, path: str) -> list[Entry]:
        """The entries of a folder, by name."""
        p, fs = self._at(path)
        found = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p)]
        return sorted(found, key=lambda e: e.name)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
