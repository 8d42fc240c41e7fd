"""Keeping a graph up to date from a stream of change notices."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from graphspark.plans.build import build

NOTICE = "root string, at timestamp"


def watch(spark: SparkSession, notices: str, store_path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Rebuilds trees incrementally as JSON notices ``{"root": ..., "at": ...}`` arrive in the folder ``notices``.

    Each micro-batch updates every tree that it names once; a tree has its own graph below ``store_path``. A batch that
    is delivered again finds nothing changed, so results are those of exactly one delivery.
    """

    def update(batch: DataFrame, _: int) -> None:
        for row in batch.select("root").where("root IS NOT NULL").distinct().toLocalIterator():
            build(batch.sparkSession, row.root, graph_path(store_path, row.root))

    stream = spark.readStream.schema(NOTICE).json(notices)
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def graph_path(store_path: str, root: str) -> str:
    """The graph of a tree: its name, and a hash of its whole path, which tells trees of similar paths apart."""
    return f"{store_path.rstrip('/')}/{root.rstrip('/').rpartition('/')[2]}-{hashlib.sha256(root.rstrip('/').encode()).hexdigest()[:16]}"
