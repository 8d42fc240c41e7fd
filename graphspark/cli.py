"""Command line: build a graph and ask it."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import columns as C
from graphspark.operators import export
from graphspark.plans.build import build
from graphspark.plans.graph import CodeGraph
from graphspark.sources.store import Store

FOLDER = ".graphspark"


def find_store(start: str) -> str:
    """The store in this folder or the nearest one above."""
    folder = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(folder, FOLDER)):
            return os.path.join(folder, FOLDER)
        if os.path.dirname(folder) == folder:
            return os.path.join(os.path.abspath(start), FOLDER)
        folder = os.path.dirname(folder)


def rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*[C.location_order(F.col(o)) if o == "at" else F.col(o) for o in order]).collect()]


def answer(g: CodeGraph, a: argparse.Namespace) -> dict:
    """The result of a query as the nested dictionary that ``--json`` prints."""
    if a.command == "trace":
        found = rows(g.trace(a.symbol, reverse=a.reverse, fuzzy=a.fuzzy, scope=a.scope, roles=a.kind), "at", "code", "scope")
        out: dict = {"symbol": a.symbol, "appearances": found[: a.limit]}
        if len(found) > a.limit:
            out |= {"truncated": True, "total": len(found), "hint": f"{len(found)} places, {a.limit} shown; --limit N shows more, --scope narrows"}
        if a.depth > 1 and not a.reverse:
            layers: dict[str, list] = {}
            for r in rows(g.trace_layers(a.symbol, a.depth, scope=a.scope), "depth", "at", "code"):
                layers.setdefault(f"depth_{r.pop('depth')}", []).append(r)
            out["depth_layers"] = layers
        return out
    if a.command == "info":
        if a.scope is None and (several := rows(g.ambiguous(a.symbol), "kind_order", "id")):
            return {"symbol": a.symbol, "ambiguous": True, "matches": several, "hint": "use --scope"}
        found = rows(g.info(a.symbol, a.scope), "id")
        return {"symbol": a.symbol, "found": bool(found)} | (found[0] if found else {})
    if a.command == "at":
        nodes, edges = g.at(a.place)
        listed = rows(edges, "from_node", "to_node")
        return {"location": a.place, "code": listed[0]["code"] if listed else "", "symbols": rows(nodes, "id"), "edges": listed}
    if a.command == "search":
        found = rows(g.search(a.text, file_filter=a.file), "at")
        return {"query": a.text, "results": found[: a.limit], "total": len(found), "truncated": len(found) > a.limit}
    if a.command == "file":
        return {"file": a.path, "defines": rows(g.file_defines(a.path), "at"), "imports": rows(g.file_imports(a.path), "at"), "imported_by": rows(g.file_imported_by(a.path), "file", "code")}
    if a.command == "dead":
        return {"dead_symbols": rows(g.dead(a.scope), "id"), "dead_chains": rows(g.dead_chains().where("depth > 0"), "depth", "id")}
    if a.command == "impact":
        out = {"target": a.target, "direct_callers": [], "direct_callees": [], "transitive": []}
        for r in rows(g.impact(a.target, scope=a.scope, depth=a.depth), "depth", "at", "code"):
            out[r.pop("tier")].append(r)
        return out
    if a.command == "api":
        if a.path is None:
            paths = rows(g.api_paths(), "path")
            return {"paths": sorted(paths, key=lambda r: -r["references"]), "total_paths": len(paths)}
        by_file: dict[str, list] = {}
        for r in rows(g.api_references(a.path), "file", "at"):
            by_file.setdefault(r.pop("file"), []).append(r)
        return {"path": a.path, "total_references": sum(map(len, by_file.values())), "by_file": [{"file": f, "references": r} for f, r in by_file.items()]}
    if a.command == "cycles":
        found = rows(g.cycles(a.longest), "length", "chain")
        return {"cycles": found, "total": len(found)}
    if a.command == "types":
        groups: dict[str, dict] = {}
        for r in rows(g.type_definitions(a.name), "name", "file", "id"):
            groups.setdefault(r["name"], {"name": r["name"], "definitions": [], "mismatches": []})["definitions"].append(r)
        for r in rows(g.type_mismatches(a.name), "name", "file"):
            groups[r["name"]]["mismatches"].append(r)
        return {"type_groups": list(groups.values()), "total": len(groups)}
    return {r["table"]: r["rows"] for r in g.stats().collect()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphspark", description=__doc__)
    top.add_argument("--store", help="folder of the graph; the nearest one above by default")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *arguments: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        for names, options in arguments:
            p.add_argument(*names, **options)
        p.add_argument("--json", action="store_true", help="print JSON")
        return p

    scope, limit = (("--scope",), {}), (("--limit",), {"type": int, "default": 50})
    command("build", "build or update the graph of a source tree", (("root",), {}), (("--full",), {"action": "store_true"}), (("--lang",), {}))
    command("trace", "where a symbol appears", (("symbol",), {}), scope, limit, (("--reverse",), {"action": "store_true"}), (("--fuzzy",), {"action": "store_true"}), (("--depth",), {"type": int, "default": 1}), (("--kind",), {"help": "roles, by comma"}))
    command("info", "what a symbol is", (("symbol",), {}), scope)
    command("at", "what is at file:line", (("place",), {}))
    command("search", "text in code and names", (("text",), {}), limit, (("--file",), {}))
    command("file", "what a file defines and imports, and who imports it", (("path",), {}))
    command("dead", "functions and classes that nothing uses", scope)
    command("impact", "what a change reaches", (("target",), {}), scope, (("--depth",), {"type": int, "default": 3}))
    command("api", "HTTP paths in code", (("path",), {"nargs": "?"}))
    command("cycles", "import cycles", (("--longest",), {"type": int, "default": 6}))
    command("types", "types that several languages define", (("name",), {"nargs": "?"}))
    command("stats", "numbers of rows")
    command("export", "the graph as GraphML, DOT or JSON", (("--format",), {"choices": export.FORMATS, "default": "graphml"}), (("--include-external",), {"action": "store_true"}), (("--output",), {"help": "folder to write to; standard output by default"}))
    return top


def show(result: dict) -> str:
    """Plain text: one line for each value, one for each row of a list."""
    out = []
    for key, value in result.items():
        if isinstance(value, list):
            out += [f"{key}: {len(value)}", *("  " + "  ".join(f"{k}={v}" for k, v in x.items()) if isinstance(x, dict) else f"  {x}" for x in value)]
        else:
            out.append(f"{key}: {value}")
    return "\n".join(out)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, write: Callable[[str], object] = print) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("graphspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = a.store or (os.path.join(os.path.abspath(a.root), FOLDER) if a.command == "build" else find_store("."))
    try:
        if a.command == "build":
            result = build(spark, a.root, store, full=a.full, language=a.lang)
        elif a.command == "export":
            graph = Store(spark, store).graph()
            if a.output:
                export.write(graph, a.format, a.output, a.include_external)
                return 0
            for line in export.each_line(graph, a.format, a.include_external):
                write(line)
            return 0
        else:
            result = answer(Store(spark, store).graph(), a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    write(json.dumps(result, ensure_ascii=False, indent=2, default=str) if a.json else show(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
