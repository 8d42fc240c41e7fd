"""Building a graph: scan, extract, normalise, resolve, write; with what an earlier build left, only what changed is read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.operators import normalize, resolve
from graphspark.schema import EDGE, NODE, TRANSFORM
from graphspark.sources.store import Store
from graphspark.sources.tree import scan

_SEQ = [T.StructField("path", T.StringType()), T.StructField("seq", T.LongType())]
RAW = T.StructType([*_SEQ, T.StructField("node", NODE), T.StructField("edge", EDGE), T.StructField("transform", TRANSFORM)])


def extract_facts(files: DataFrame) -> DataFrame:
    """A row for each fact of each file, one of ``node``, ``edge``, ``transform`` set; files that are not UTF-8 give none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from graphspark.extract import extract

        for batch in batches:
            for path, language, content in zip(batch["path"], batch["lang"], batch["content"], strict=True):
                try:
                    facts = extract(path, bytes(content).decode("utf-8"), language)
                except UnicodeDecodeError:
                    continue
                if facts is None:
                    continue
                rows = [(path, n, x, None, None) for n, x in enumerate(facts.nodes.values())]
                rows += [(path, n, None, x, None) for n, x in enumerate(facts.edges.values())]
                rows += [(path, n, None, None, x) for n, x in enumerate(facts.transforms)]
                yield pd.DataFrame(rows, columns=RAW.names)

    return files.select("path", "lang", "content").mapInPandas(run, RAW)


def raw_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The facts as tables of nodes, edges and transforms with the file and the place in it they come from."""
    return {f"raw_{kind}s": facts.where(f"{kind} IS NOT NULL").select("path", "seq", f"{kind}.*") for kind in ("node", "edge", "transform")}


def finish(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Normalised and resolved tables from raw ones."""
    ordered = {k: df.withColumn("seq", F.struct("path", "seq")).drop("path") for k, df in raw.items()}
    nodes = normalize.merge_nodes(ordered["raw_nodes"])
    edges = normalize.dedupe_edges(ordered["raw_edges"])
    nodes = nodes.unionByName(normalize.missing_externals(nodes, edges)).select(*NODE.names)
    edges = resolve.resolve(nodes, edges).select(*EDGE.names)
    return {"nodes": nodes, "edges": edges, "transforms": normalize.dedupe_transforms(ordered["raw_transforms"]).select(*TRANSFORM.names)}


def changes(files: DataFrame, before: DataFrame | None) -> DataFrame:
    """``(path, change)`` of new, changed and removed files by their hashes."""
    now = files.select("path", F.col("source_hash").alias("now"))
    was = before.select("path", F.col("source_hash").alias("was")) if before is not None else now.select("path", F.col("now").alias("was")).limit(0)
    both = now.join(was, "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def build(spark: SparkSession, root: str, store_path: str, *, full: bool = False, language: str | None = None) -> dict:
    """Builds or updates the graph of a tree; returns counts and ``status``: ``empty``, ``ok`` or ``unchanged``.

    Raw facts of unchanged files are taken from the version before; names are resolved anew over all files, so a change
    in one file reaches the edges of all others. ``full`` takes nothing from before.
    """
    store = Store(spark, store_path)
    files = scan(spark, root, language).persist()
    total = files.count()
    if total == 0:
        return {"status": "empty", "files": 0, "changed_files": 0, "total_files": 0}
    before = None if full else store.read("files")
    changed = changes(files, before).persist()
    n_changed = changed.count()
    if n_changed == 0:
        return {"status": "unchanged", "changed_files": 0, "total_files": total} | _stats(store)
    # Each of the tables below reads the facts, and parsing is the dearest step.
    facts = extract_facts(files.join(changed.where("change <> 'removed'"), "path", "left_semi")).persist()
    fresh = raw_tables(facts)
    if before is not None:
        gone = changed.select("path")
        fresh = {k: store.read(k).join(gone, "path", "left_anti").unionByName(df) for k, df in fresh.items()}
    tables = {"files": files.select("path", "lang", "source_hash", "size")} | fresh
    written = store.write({**tables, **finish(fresh)})
    for df in (files, changed, facts):
        df.unpersist()
    store.vacuum()
    return {"status": "ok", "changed_files": n_changed, "total_files": total, "version": written} | _stats(store)


def _stats(store: Store) -> dict:
    return {r["table"]: r["rows"] for r in store.graph().stats().collect()}


