"""Iterative graph operators: level-synchronous search, components, strongly connected components, cycles, fixpoints.

Every loop runs on the driver, but each step is one distributed job; the driver only learns whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.checkpoints import cut


def bfs_levels(seeds: DataFrame, arcs: DataFrame, depth: int) -> DataFrame:
    """``(id, depth)`` of all nodes within ``depth`` steps of the seeds, each at its least depth; seeds have depth 0.

    ``seeds`` has a column ``id``; ``arcs`` has ``src`` and ``dst`` and is followed from src to dst.
    """
    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = cut(reached)
    reached = frontier
    for level in range(1, depth + 1):
        step = frontier.join(arcs, frontier["id"] == arcs["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(reached, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def dead_fixpoint(candidates: DataFrame, roots: DataFrame, uses: DataFrame) -> DataFrame:
    """``(id, depth)``: the least set with all roots (depth 0) and every candidate used only from inside the set.

    ``candidates`` and ``roots`` have ``id``; ``uses`` has ``src`` and ``dst``, src using dst. Rounds go on until nothing
    is added; each looks only at what the last one's symbols use.
    """
    new = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    inner = cut(uses.join(candidates.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct())
    dead, level = new, 0
    while not new.isEmpty():
        level += 1
        touched = inner.join(new.select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct()
        marked = inner.join(touched, "dst", "left_semi").join(dead.select(F.col("id").alias("src"), F.lit(1).alias("gone")), "src", "left")
        full = marked.groupBy(F.col("dst").alias("id")).agg(F.count("gone").alias("gone"), F.count(F.lit(1)).alias("all")).where("gone = all").select("id")
        new = cut(full.join(dead, "id", "left_anti").withColumn("depth", F.lit(level)))
        dead = _grown(dead, new, level)
    return dead


def _grown(whole: DataFrame, part: DataFrame, step: int) -> DataFrame:
    """A union that grows by a part at each step; now and then it is written as one, so that plans stay short."""
    out = whole.union(part)
    return cut(out) if step % 16 == 0 else out


def strongly_connected(arcs: DataFrame) -> DataFrame:
    """``(id, component)`` of nodes on a cycle of ``arcs(src, dst)``; the component is its least node.

    Trims what has no way in or out, then labels every node with the least node that reaches it and, among nodes of one
    label, with the least that it reaches: nodes where both are the same form a component, and the rest goes round again.
    """
    arcs = cut(arcs.select("src", "dst").where("src <> dst").distinct())
    done: DataFrame | None = None
    rounds = 0
    while True:
        while True:
            inside = arcs.join(arcs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(arcs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            trimmed = cut(inside)
            if trimmed.count() == arcs.count():
                break
            arcs = trimmed
        if arcs.isEmpty():
            break
        rounds += 1
        forward = _least_label(arcs)
        same = arcs.join(forward.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(forward.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = _least_label(cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        found = cut(back.withColumnRenamed("label", "component").join(forward.select("id", F.col("label").alias("component")), ["id", "component"]))
        done = found if done is None else _grown(done, found, rounds)
        gone = found.select("id")
        arcs = cut(arcs.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return arcs.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = done.groupBy("component").count().where("count > 1").select("component")
    return done.join(sizes, "component", "left_semi").select("id", "component")


def _least_label(arcs: DataFrame) -> DataFrame:
    """The least node that reaches each node.

    What reaches a node's label reaches the node, so labels also jump to the labels of their labels, and long chains take
    far fewer rounds than they have steps.
    """
    labels = cut(arcs.select(F.col("src").alias("id")).union(arcs.select("dst")).distinct().withColumn("label", F.col("id")))
    while True:
        seen = arcs.join(labels, arcs["src"] == labels["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, "id", "left").select("id", F.least("label", F.coalesce("seen", "label")).alias("near"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("jump"))
        new = cut(near.join(jump, "near").select("id", F.least("near", "jump").alias("label"), "was"))
        labels, changed = new.select("id", "label"), new.where("label <> was")
        if changed.isEmpty():
            return labels


def simple_cycles(arcs: DataFrame, longest: int) -> DataFrame:
    """``(chain, length)`` of the simple cycles of up to ``longest`` nodes, each once, starting at its least node.

    Only arcs inside strongly connected components can be part of one, so paths grow over these alone, from their least
    node through larger ones.
    """
    component = strongly_connected(arcs)
    inner = arcs.select("src", "dst").distinct().join(component.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(component.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a = b AND src <> dst").select("src", "dst")
    inner = cut(inner)
    paths = inner.where("dst > src").select(F.col("src").alias("start"), F.array("src", "dst").alias("chain"), F.col("dst").alias("last"))
    out = None
    for length in range(2, longest + 1):
        closing = paths.join(inner, (paths["last"] == inner["src"]) & (paths["start"] == inner["dst"]), "left_semi").select("chain", F.lit(length).alias("length"))
        out = closing if out is None else out.union(closing)
        if length < longest:
            grown = paths.join(inner, paths["last"] == inner["src"]).where("dst > start").where(~F.array_contains("chain", F.col("dst")))
            paths = cut(grown.select("start", F.concat("chain", F.array("dst")).alias("chain"), F.col("dst").alias("last")))
            if paths.isEmpty():
                break
    return out
