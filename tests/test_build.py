"""Builds of small trees, and what queries, exports, the command line and streams make of them."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET

import pytest

from graphspark import cli
from graphspark.operators import export
from graphspark.plans.build import build
from graphspark.plans.graph import CodeGraph
from graphspark.sources.store import Store
from graphspark.sources.tree import list_sources
from graphspark.streaming.rebuild import graph_path, watch

TREE = {
    "app/__init__.py": "",
    "app/service.py": "from app.store import load, save\nfrom app.views import main\n\ndef handle(user_id, extra=None):\n    row = load(user_id)\n    save(row, table=extra)\n    return row\n\ndef unused():\n    return 1\n\ndef _hidden():\n    return fetch('/api/items')\n",
    "app/store.py": "def load(key):\n    return key\n\ndef save(value, table):\n    return table\n\ndef test_thing():\n    pass\n",
    "app/views.py": "from app.service import handle\n\ndef main():\n    handle(1)\n",
    "web/client.ts": "interface Item { id: number; label: string }\nfunction show(i: Item) { return fetch('/api/items'); }\nexport { show };\n",
    "srv/item.go": 'package srv\ntype Item struct {\n\tID int\n\tLabel string\n}\nfunc Exported() { helper(1) }\n',
    "srv/util.go": "package srv\nfunc helper(n int) int { return n }\n",
    "node_modules/x.js": "function no() {}",
    ".hidden/y.py": "def no(): pass",
    "dist/z.py": "def no(): pass",
    "notes.txt": "text",
}


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, store = str(tmp_path_factory.mktemp("tree")), str(tmp_path_factory.mktemp("store"))
    put(root, TREE)
    result = build(spark, root, store)
    return root, store, result, Store(spark, store).graph()


def ids(df):
    return {r.id for r in df.collect()}


def test_sources(built):
    assert list_sources(built[0]) == ["app/__init__.py", "app/service.py", "app/store.py", "app/views.py", "srv/item.go", "srv/util.go", "web/client.ts"]
    assert list_sources(built[0], "go") == ["srv/item.go", "srv/util.go"]


def test_result(built):
    assert built[2]["status"] == "ok" and built[2]["changed_files"] == built[2]["total_files"] == built[2]["files"] == 7


def test_calls_resolve_across_files(built):
    calls = {(r.from_node, r.to_node) for r in built[3].edges.where("edge_type = 'calls'").collect()}
    assert {("app/views.py#main", "app/service.py#handle"), ("app/service.py#handle", "app/store.py#load"), ("srv/item.go#Exported", "srv/util.go#helper")} <= calls


def test_parameters_flow(built):
    flows = {(r.from_node, r.to_node) for r in built[3].edges.where("edge_type = 'param-flow'").collect()}
    assert {("app/service.py#handle.user_id", "app/store.py#load.key"), ("app/service.py#handle.row", "app/store.py#save.value"), ("app/service.py#handle.extra", "app/store.py#save.table")} <= flows


def test_dead(built):
    got = {r.id: r.confidence for r in built[3].dead().collect()}
    assert got == {"app/service.py#unused": "high", "app/service.py#_hidden": "medium", "app/store.py#test_thing": "low", "srv/item.go#Exported": "medium"}
    assert "srv/util.go#helper" in ids(built[3].dead_chains())


def test_cycles(built):
    assert [r.chain for r in built[3].cycles(3).collect()] == [["app/service.py", "app/views.py"]]
    assert {(r.id, r.component) for r in built[3].cycle_components().collect()} == {("app/service.py", "app/service.py"), ("app/views.py", "app/service.py")}


def test_types_api_and_impact(built):
    assert [(r.name, r.file, r.base_file, r.kind) for r in built[3].type_mismatches().collect()] == [("Item", "web/client.ts", "srv/item.go", "case")]
    assert {(r.path, r.references) for r in built[3].api_paths().collect()} == {("/api/items", 4)}
    assert {r.tier for r in built[3].impact("handle").collect()} == {"direct_callees", "direct_callers"}
    assert {r.role for r in built[3].trace("handle").collect()} >= {"definition", "call", "import"}


def test_rebuild_without_and_with_a_change(spark, tmp_path):
    root, store = str(tmp_path / "tree"), str(tmp_path / "store")
    put(root, {"a.py": "def f(x):\n    return x\n", "b.py": "from a import f\ndef g(y):\n    return f(y)\n"})
    build(spark, root, store)
    assert build(spark, root, store)["status"] == "unchanged"
    put(root, {"a.py": "\n\ndef f(z):\n    return z\n"})
    assert build(spark, root, store)["changed_files"] == 1
    graph = Store(spark, store).graph()
    # The edge of the unchanged file into the changed one is still there, and so is the flow to the new parameter.
    edges = {(r.edge_type, r.from_node, r.to_node) for r in graph.edges.collect()}
    assert ("calls", "b.py#g", "a.py#f") in edges and ("param-flow", "b.py#g.y", "a.py#f.z") in edges
    os.remove(os.path.join(root, "b.py"))
    assert build(spark, root, store)["changed_files"] == 1
    assert not [i for i in ids(Store(spark, store).graph().nodes) if i.startswith("b.py")]
    assert build(spark, root, store, full=True)["changed_files"] == 1
    assert Store(spark, store).vacuum(1)


def test_empty_tree(spark, tmp_path):
    put(str(tmp_path / "tree"), {"a.txt": "x"})
    assert build(spark, str(tmp_path / "tree"), str(tmp_path / "store"))["status"] == "empty"


def test_exports(built, spark, tmp_path):
    graphml = ET.fromstring(export.text(built[3], "graphml"))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert {k.get("attr.name") for k in graphml.iter(f"{space}key")} == {"kind", "name", "scope", "edge_type"}
    nodes = {n.get("id") for n in graphml.iter(f"{space}node")}
    assert all(e.get("source") in nodes and e.get("target") in nodes for e in graphml.iter(f"{space}edge")) and "app/service.py#handle" in nodes
    odd = CodeGraph(spark.createDataFrame([('a#"x"', "Function", 'say "<hi>"\n', "a")], "id string, kind string, name string, scope string"), built[3].edges.limit(0))
    assert r"\"x\"" in export.text(odd, "dot") and r"say \"<hi>\"\n" in export.text(odd, "dot")
    assert ET.fromstring(export.text(odd, "graphml")) is not None
    assert all(json.loads(line) for line in export.text(built[3], "json").splitlines())
    export.write(built[3], "dot", str(tmp_path / "dot"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "dot")).collect()).startswith("digraph")
    with pytest.raises(ValueError):
        export.text(built[3], "svg")


def test_command_line(built, spark):
    def run(*arguments):
        out: list[str] = []
        code = cli.main(["--store", built[1], *arguments, "--json"], spark, out.append)
        return code, json.loads(out[0]) if out else None

    assert run("stats")[1]["files"] == 7
    assert run("trace", "handle", "--depth", "2", "--limit", "1")[1]["truncated"] is True
    assert run("info", "handle", "--scope", "app/service.py")[1]["params"][0]["name"] == "user_id" and run("info", "nothing")[1]["found"] is False
    assert run("at", "app/views.py:4")[1]["code"] == "handle(1)"
    assert run("search", "/API/items")[1]["total"] == 4
    assert {d["symbol"] for d in run("file", "app/store.py")[1]["defines"]} == {"load", "save", "test_thing"}
    assert len(run("dead")[1]["dead_symbols"]) == 4 and run("impact", "load")[1]["direct_callers"]
    assert run("api")[1]["total_paths"] == 1 and run("api", "/api/items")[1]["total_references"] == 4
    assert run("cycles")[1]["total"] == 1 and run("types")[1]["total"] == 1
    assert run("at", "nowhere") == (1, None)
    text: list[str] = []
    assert cli.main(["--store", built[1], "export", "--format", "dot"], spark, text.append) == 0 and text[0].startswith("digraph")
    assert cli.main(["--store", built[1] + "/none", "stats"], spark, text.append) == 1


def test_stream_of_notices(spark, tmp_path):
    root, notices, store = (str(tmp_path / x) for x in ("tree", "notices", "graphs"))
    put(root, {"a.py": "def f(): pass\n"})
    put(notices, {"1.json": json.dumps({"root": root, "at": "2024-01-01T00:00:00Z"})})
    watch(spark, notices, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert "a.py#f" in ids(Store(spark, graph_path(store, root)).graph().nodes)
    put(root, {"a.py": "def g(): pass\n"})
    put(notices, {"2.json": json.dumps({"root": root, "at": "2024-01-01T00:01:00Z"})})
    watch(spark, notices, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert {"a.py#g"} == {i for i in ids(Store(spark, graph_path(store, root)).graph().nodes) if i.startswith("a.py#") and i != "a.py#"}
