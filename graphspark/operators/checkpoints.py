"""Cutting the lineage of iterations, and keeping tables that many queries read.

Both use the folder of ``spark.checkpoint.dir``, which all executors share and which outlives lost executors. Only where
the session names no folder, as in tests, one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="graphspark-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` evaluated once; what reads it starts from the result.

    A written table, for its size is known: a checkpoint goes on with the estimate of its plan, which grows without
    bounds over the rounds of a loop.
    """
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet: readers take the columns and row groups they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
