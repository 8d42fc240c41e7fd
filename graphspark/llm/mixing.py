"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``rate`` times its size takes every document ``floor(rate)`` times and once more with
probability ``rate - floor(rate)``. The cube method makes these last draws: it moves the inclusion probabilities along
the null space of the balancing constraints (number of documents, number of words) until they are 0 or 1, so both totals
stay as they were. With two constraints the direction through any three documents is known in closed form, and at most
two documents stay undecided in a block. Blocks of bounded size run in parallel; their undecided documents meet in
blocks of the next level, until one block of a source is left, whose last ones are rounded towards the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.storage import first_of, materialise, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
EDGE = 1e-9


def numbered(totals: DataFrame) -> DataFrame:
    """``totals`` with ``no``, the place of each source in the order of code points from 0, null last.

    Range partitions are sorted side by side; only their row counts come to the driver.
    """
    ordered = totals.orderBy(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    ordered = materialise(ordered, "mix-ordered")
    before, first = 0, F.lit(None).cast("long")
    for r in ordered.groupBy("part").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect():
        first = F.when(F.col("part") == r["part"], F.lit(before - r["least"])).otherwise(first)
        before += r["rows"]
    return ordered.withColumn("no", F.col("place") + first).drop("part", "place")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals`` (``source size``) with ``no`` and ``target``, the words that each source gives.

    Sources share ``share`` of all words by weight, none above ``most`` times its own. Sources are ordered by code point
    with null last and take the weights in turn. What a full source can't take is shared by weight among the others: the
    level of a unit of weight rises until no more sources are full, one aggregate a round, whatever their number.
    """
    table = materialise(numbered(totals).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))), "mix-weights")
    limit, level, was = most * F.col("size"), 0.0, -1
    full = F.lit(False)
    while True:
        sums = table.agg(F.count_if(full).alias("n"), F.sum("size").alias("all"), F.sum(F.when(full, limit).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if sums["n"] == was or not sums["weight"]:
            break
        was, level = sums["n"], (share * sums["all"] - sums["given"]) / sums["weight"]
        full = F.col("weight") * level > limit
    return table.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * level)).drop("weight")


def fly(size: np.ndarray, chance: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """The flight phase over one block: probabilities with the same sums of chances and words, at most two between 0 and 1.

    Documents are met in the order given; the last ones tend to stay undecided, so put small ones last.
    """
    size, chance = size.astype(float).tolist(), chance.astype(float).tolist()
    draws = np.random.default_rng(seed).random(len(chance)).tolist()
    active: list[int] = []
    for k in range(len(chance)):
        if not EDGE < chance[k] < 1 - EDGE:
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, d in zip(active, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - chance[i]) / d), min(down, chance[i] / d)
                elif d < 0:
                    up, down = min(up, -chance[i] / d), min(down, -(1 - chance[i]) / d)
            step = up if draws[k] * (up + down) < down else -down
            for i, d in zip(active, u, strict=True):
                chance[i] += step * d
            active = [i for i in active if EDGE < chance[i] < 1 - EDGE]
    return np.array([round(x) if x <= EDGE or x >= 1 - EDGE else x for x in chance])


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The undecided documents, 20 at most, rounded so that words, then documents, come nearest to their expected totals."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    takes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    moved = takes - chance[open_]
    out = chance.copy()
    out[open_] = takes[np.argmin(np.abs(moved @ size[open_]) + np.abs(moved.sum(axis=1)))]
    return out


def fly_holding(size: np.ndarray, chance: np.ndarray, seed: int | list[int], landing: int = 14) -> np.ndarray:
    """Flight over all but ``landing`` documents of various sizes, which stay undecided for the landing problem."""
    undecided = np.flatnonzero((chance > EDGE) & (chance < 1 - EDGE))
    held = np.unique(undecided[np.linspace(0, len(undecided) - 1, min(landing, len(undecided))).astype(int)])
    flying = np.setdiff1d(np.arange(len(chance)), held)
    out = chance.astype(float).copy()
    out[flying] = fly(size[flying], chance[flying], seed)
    return out


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 4000, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: the key, the source, ``size source_size target copies taken text_hash``.

    ``size`` counts the words between white space; null and empty texts have none. ``taken`` is ``copies * size``, and
    ``copies`` is at most ``ceil(most)``. Null is a source of its own. Rows of equal content each get their own draw. An
    empty table gives an empty table. The same rows give the same mix, however they are partitioned.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    # Rows that are alike throughout are told apart by a number, so that they spread over the blocks.
    alike = materialise(rows.groupBy("key", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("alike")), "mix-sizes")
    totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("size"), F.sum("alike").alias("n"))
    goal = targets(totals, weights, share, most)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(rate + EDGE), F.lit(int(np.ceil(most)))).cast("int")
    plan = goal.select(F.col("source").alias("of"), "no", F.col("size").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("chance"), F.ceil(F.col("n") / block).alias("blocks"))
    plan = materialise(plan, "mix-plan")
    most_blocks = plan.agg(F.max("blocks")).first()[0] or 1
    single = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))).drop("alike")
    joined = single.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("key", "source", "size", "text_hash", "nth", "no", "source_size", "target", "whole", "chance", F.pmod(F.xxhash64("key", "size", "text_hash", "nth"), "blocks").alias("block"))

    def flight(final: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "text_hash", "key", "nth"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            size, chance = group["size"].to_numpy(), group["chance"].to_numpy()
            no, block = int(group["no"].iloc[0]), int(group["block"].iloc[0])
            # The first block of a source keeps some documents of various sizes for the landing problem.
            chance = (fly_holding if block == 0 else fly)(size, chance, [seed, no, block, int(final)])
            if final:
                chance = land(size, chance)
            return group.assign(chance=chance)

        return run

    done = []
    while True:
        final = most_blocks == 1
        flown = materialise(joined.groupBy("no", "block").applyInPandas(flight(final), joined.schema), "mix-flight")
        if final:
            done.append(flown)
            break
        undecided = F.col("chance").between(EDGE, 1 - EDGE)
        done.append(flown.where(~undecided))
        # About two documents of each block go on, so a block of the next level takes those of block / 2 blocks.
        joined = flown.where(undecided).withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long"))
        most_blocks = -(-most_blocks // (block // 2))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("chance").cast("int")).alias("copies")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies, (copies * F.col("size")).cast("long").alias("taken"), "text_hash")


def take(docs: DataFrame, mixed: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with the columns of ``docs``, whatever their names.

    Rows that agree in key, source and text together come as often as all of them were taken; if they differ in other
    columns, the one with the least hash of all its columns is repeated. Empty tables give an empty table.
    """
    decided = mixed.groupBy(F.col(key).alias("of_key"), F.col(source).alias("of_source"), F.col("text_hash").alias("of_hash")).agg(F.sum("copies").alias("times")).where("times > 0")
    own = docs.select(whole_row(docs), F.col(key).alias("own_key"), F.col(source).alias("own_source"), F.xxhash64(text).alias("own_hash"))
    joined = own.join(decided, F.col("own_key").eqNullSafe(F.col("of_key")) & F.col("own_source").eqNullSafe(F.col("of_source")) & (F.col("own_hash") == F.col("of_hash")))
    once = first_of(joined, "own_key", "own_source", "own_hash")
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
