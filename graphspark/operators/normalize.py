"""Merging the raw facts of all files: one row for each node, edge and transform, and nodes for externals that are only named."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions import columns as C
from graphspark.schema import EXTERNAL


def merge_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each id: the first row's values, the first annotation that isn't empty, the earliest location, any ``is_param``.

    ``order`` numbers the raw rows of an id; locations compare by line and column as numbers.
    """
    kept = [c for c in nodes.columns if c not in ("id", "type_annotation", "is_param", "location", order)]
    place = F.struct(C.location_line(F.col("location")).alias("line"), C.location_col(F.col("location")).alias("col"), F.col("location").alias("location"))
    merged = nodes.groupBy("id").agg(
        F.min_by(F.struct(*kept), order).alias("first"),
        F.min_by("type_annotation", F.when(F.col("type_annotation") != "", F.col(order))).alias("annotation"),
        F.max("is_param").alias("is_param"), F.min(place).alias("place"),
    )
    values = {c: F.col(f"first.{c}") for c in kept} | {"type_annotation": F.coalesce("annotation", F.lit("")), "is_param": F.col("is_param"), "location": F.col("place.location")}
    return merged.select("id", *[values[c].alias(c) for c in nodes.columns if c not in ("id", order)])


def dedupe_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each (from, to, type, location): the first row, with the metadata of the last that has any."""
    key = ["from_node", "to_node", "edge_type", "location"]
    kept = [c for c in edges.columns if c not in (*key, "metadata", order)]
    said = F.when(~F.coalesce("metadata", F.lit("")).isin("", "{}"), F.col(order))
    merged = edges.groupBy(*key).agg(F.min_by(F.struct(*kept), order).alias("first"), F.coalesce(F.max_by("metadata", said), F.lit("{}")).alias("metadata"))
    return merged.select(*[F.col(f"first.{c}").alias(c) if c in kept else F.col(c) for c in edges.columns if c != order])


def dedupe_transforms(transforms: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each (op, location) with the inputs and outputs of all its rows."""
    key, lists = ["op", "location"], ["inputs", "outputs"]
    kept = [c for c in transforms.columns if c not in (*key, *lists, order)]
    merged = transforms.groupBy(*key).agg(F.min_by(F.struct(*kept), order).alias("first"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
    return merged.select(*[F.col(f"first.{c}").alias(c) if c in kept else F.col(c) for c in transforms.columns if c != order])


def missing_externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for external ends of edges that have none."""
    ends = edges.select(F.col("from_node").alias("id"), "location").union(edges.select("to_node", "location")).where(F.col("id").startswith(EXTERNAL))
    missing = ends.join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.min(C.location_order(F.col("location"))).alias("x"))
    values = {"id": F.col("id"), "kind": F.lit("External"), "name": F.substr("id", F.lit(len(EXTERNAL) + 1)), "location": F.col("x.location"), "end_location": F.col("x.location"), "is_param": F.lit(0)}
    return missing.select(*[values.get(c, F.lit("")).cast(t).alias(c) for c, t in nodes.dtypes])


def scope_index(nodes: DataFrame) -> DataFrame:
    """``(scope, name, ids)``: what a name means in a scope."""
    return nodes.groupBy("scope", "name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def scope_parents(nodes: DataFrame) -> DataFrame:
    """``(scope, parent)``: each scope and the one around it; a file's scope has none."""
    inner = F.regexp_extract("scope", r"^(.*)[.:][^.:]*$", 1)
    return nodes.select("scope").where("scope <> ''").distinct().select("scope", F.when(F.contains("scope", F.lit(":")), inner).alias("parent"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last: the upsert of tables that can't be updated in place."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", order)
