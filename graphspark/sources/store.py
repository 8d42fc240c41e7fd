"""Versioned Parquet tables of a graph: a build writes a new version, then a new pointer names it.

Pointers are files with rising numbers, made by renaming a whole file to a name that nobody has yet; the highest counts.
So at every moment readers find the old version or the new one, also if a build dies in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphspark.plans.graph import CodeGraph

TABLES = ("files", "raw_nodes", "raw_edges", "raw_transforms", "nodes", "edges", "transforms")
PARTITIONS = {"nodes": "kind", "edges": "edge_type"}
POINTER = "_CURRENT"
#: Pointers that stay behind the newest, for readers that are listing them.
KEPT_POINTERS = 5


class Store:
    """A folder on any file system that Spark reaches; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, object]]:
        """Numbers and paths of all pointers, the newest first."""
        folder = self._path(self.path)
        if not self._fs.exists(folder):
            return []
        named = [(s.getPath().getName(), s.getPath()) for s in self._fs.listStatus(folder)]
        return sorted(((int(n.removeprefix(POINTER + "-")), p) for n, p in named if n.startswith(POINTER + "-") and n.rpartition("-")[2].isdigit()), key=lambda x: -x[0])

    def current(self) -> str | None:
        """The version that readers see; None before the first build."""
        for _, pointer in self._pointers():
            stream = self._fs.open(pointer)
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return None

    def read(self, table: str) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}/{table}")

    def graph(self) -> CodeGraph:
        if self.current() is None:
            raise FileNotFoundError(f"no graph in {self.path}; build one first")
        return CodeGraph(*(self.read(t) for t in ("nodes", "edges", "transforms", "files")))

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Writes a version, then flips the pointer; if anything fails the pointer stays."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write
            if name in PARTITIONS:
                writer = writer.partitionBy(PARTITIONS[name])
            writer.parquet(f"{self.path}/{version}/{name}")
        self.publish(version)
        return version

    def publish(self, version: str) -> None:
        new = self._path(f"{self.path}/_new-{version}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        found = self._pointers()
        number = found[0][0] + 1 if found else 1
        # A rename that finds the name taken fails: another build was faster, and this one comes after it.
        while self._fs.exists(self._path(f"{self.path}/{POINTER}-{number}")) or not self._fs.rename(new, self._path(f"{self.path}/{POINTER}-{number}")):
            number += 1
        for _, pointer in self._pointers()[KEPT_POINTERS:]:
            self._fs.delete(pointer, False)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the ``keep`` newest versions; the current one always stays."""
        current = self.current()
        found = [s for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory()]
        found.sort(key=lambda s: s.getModificationTime(), reverse=True)
        old = [s.getPath() for s in found[keep:] if s.getPath().getName() != current]
        for path in old:
            self._fs.delete(path, True)
        return [p.getName() for p in old]
