"""Connected components of a distributed edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm.storage import drop, materialise


def starred(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(x, y)``: edges with the same nodes and components, without a join.

    A node keeps the edge to its least neighbour, to which its other lesser neighbours go over. Where many nodes have the
    same few neighbours, as members of buckets have their leaders, about one edge for each node is left of all these.
    """
    ordered = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).withColumn("to", F.min("x").over(Window.partitionBy("y")))
    ends = F.array("y", F.when(F.col("x") != F.col("to"), F.col("x")))
    return ordered.select(F.col("to").alias("x"), F.explode(ends).alias("y")).where("y IS NOT NULL").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge; the component is its least node.

    Every round takes the least label among a node's neighbours, then the label of that label, and writes the labels to
    the shared folder, so lineage stays short; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = starred(edges, a, b)
    both = materialise(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("y"), F.col("component").alias("theirs")), "y").groupBy(F.col("x").alias("node")).agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(seen, "node").select("node", F.least("component", "theirs").alias("to"), F.col("component").alias("was"))
        jumped = nearer.join(labels.select(F.col("node").alias("to"), F.col("component").alias("next")), "to").select("node", F.least("to", "next").alias("component"), "was")
        new = materialise(jumped, "labels")
        changed = new.where("component <> was").limit(1).count()
        drop(labels)
        labels = new.select("node", "component")
        if not changed:
            drop(both)
            return labels


def merged_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of a graph whose components ``labels`` are known, after ``edges`` more: only these, between labels, go round."""
    pairs = materialise(starred(edges, a, b), "links")
    ends = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "node")
    every = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    every = materialise(every, "labels")
    at = lambda k, to: every.select(F.col("node").alias(k), F.col("component").alias(to))
    between = pairs.join(at("x", "from"), "x").join(at("y", "to"), "y").where("from <> to").select("from", "to").distinct()
    moved = connected_components(between, "from", "to").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return every.join(moved, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
