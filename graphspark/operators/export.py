"""Graphs as GraphML, DOT and JSON lines, made line by line in Spark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.plans.graph import CodeGraph

# Colours of the DOT format.
NODE_COLOURS = {"File": "#9E9E9E", "Function": "#4CAF50", "Class": "#2196F3", "Variable": "#FFC107", "External": "#FF5722", "TypeAlias": "#9C27B0"}
EDGE_COLOURS = {"calls": "#E91E63", "reads": "#3F51B5", "imports": "#009688", "defines": "#795548"}
NODE_KEYS = ("kind", "name", "scope")
FORMATS = ("graphml", "dot", "json")


def _escaped(text: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _xml(text: Column) -> Column:
    # Control characters that XML can't hold go.
    return _escaped(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def _dot(text: Column) -> Column:
    return _escaped(text, {"\\": "\\\\", '"': '\\"', "\n": "\\n"})


def _ends(graph: CodeGraph, include_external: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and those edges whose ends are both among them."""
    nodes, edges = graph.export_nodes(include_external), graph.export_edges()
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi")
    return nodes, kept


def lines(graph: CodeGraph, fmt: str, include_external: bool = False) -> DataFrame:
    """``(part, id, line)``; sorted by part and id they are the file. Parts: 0 head, 1 nodes, 2 edges, 3 tail."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    nodes, edges = _ends(graph, include_external)
    if fmt == "graphml":
        head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'  <key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in NODE_KEYS), '  <key id="edge_type" for="edge" attr.name="edge_type" attr.type="string"/>', '  <graph edgedefault="directed">']
        tail = ["  </graph>", "</graphml>"]
        data = [F.when(F.col(k) != "", F.concat(F.lit(f'<data key="{k}">'), _xml(F.col(k)), F.lit("</data>"))).otherwise("") for k in NODE_KEYS]
        node = F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('">'), *data, F.lit("</node>"))
        edge = F.concat(F.lit('    <edge source="'), _xml(F.col("from_node")), F.lit('" target="'), _xml(F.col("to_node")), F.lit('"><data key="edge_type">'), F.col("edge_type"), F.lit("</data></edge>"))
    elif fmt == "dot":
        colour = lambda table, column: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)], F.lit("#FFFFFF"))
        head, tail = ["digraph code {", "  rankdir=LR;", "  node [shape=box, style=filled];"], ["}"]
        node = F.concat(F.lit('  "'), _dot(F.col("id")), F.lit('" [label="'), _dot(F.col("name")), F.lit('", fillcolor="'), colour(NODE_COLOURS, "kind"), F.lit('"];'))
        edge = F.concat(F.lit('  "'), _dot(F.col("from_node")), F.lit('" -> "'), _dot(F.col("to_node")), F.lit('" [label="'), F.col("edge_type"), F.lit('", color="'), colour(EDGE_COLOURS, "edge_type"), F.lit('"];'))
    else:
        head, tail = [], []
        node, edge = F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)), F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns))
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, f"{k:04d}", x) for k, x in enumerate(head)] + [(3, f"{k:04d}", x) for k, x in enumerate(tail)], "part int, id string, line string")
    body = nodes.select(F.lit(1).alias("part"), "id", node.alias("line")).union(edges.select(F.lit(2), F.concat_ws(" ", "from_node", "to_node", "edge_type"), edge))
    return fixed.union(body)


def write(graph: CodeGraph, fmt: str, path: str, include_external: bool = False) -> None:
    """Text files in the folder ``path`` whose names sort in the order of the lines."""
    lines(graph, fmt, include_external).orderBy("part", "id", "line").select("line").write.mode("overwrite").text(path)


def each_line(graph: CodeGraph, fmt: str, include_external: bool = False) -> Iterator[str]:
    """The lines of an export in order, a partition of them at a time on the driver."""
    for row in lines(graph, fmt, include_external).orderBy("part", "id", "line").toLocalIterator():
        yield row.line


def text(graph: CodeGraph, fmt: str, include_external: bool = False) -> str:
    """The whole export as one string, for graphs that the caller knows to be small."""
    return "\n".join(each_line(graph, fmt, include_external)) + "\n"
