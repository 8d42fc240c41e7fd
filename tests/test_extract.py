"""What the extractors say about small sources."""

from __future__ import annotations

import json

import pytest

from graphspark.extract import REGISTERED, extract
from graphspark.sources.languages import detect_language


def facts(path, source):
    return extract(path, source)


def kinds(f):
    return {n["id"].split("#", 1)[1]: n["kind"] for n in f.nodes.values() if not n["id"].startswith("#")}


def edges(f, kind):
    return {(e["from_node"].split("#", 1)[1], e["to_node"].split("#", 1)[1]) for e in f.edges.values() if e["edge_type"] == kind}


@pytest.mark.parametrize(("path", "language"), [("a.py", "python"), ("a.js", "javascript"), ("a.ts", "typescript"), ("a.go", "go"), ("a.txt", None)])
def test_language(path, language):
    assert detect_language(path) == language


def test_python_symbols():
    f = facts("m.py", "import os\nfrom a.b import c as d\nX: int = 1\ndef f(p: int, *rest, k=1, **kw) -> str:\n    y = p\n    return y\nclass A(object):\n    z = 1\n    async def m(self):\n        await f(self.z)\n")
    k = kinds(f)
    assert k["f"] == k["A.m"] == "Function" and k["A"] == "Class" and k["f.y"] == k["A.z"] == k["d"] == k["X"] == "Variable"
    assert {n["name"] for n in f.nodes.values() if n["is_param"]} == {"p", "rest", "k", "kw", "self"}
    assert f.nodes["m.py#f"]["type_annotation"] == "str" and f.nodes["m.py#f.p"]["type_annotation"] == "int"
    assert ("A.m", "f") in edges(f, "calls") and ("f", "f.y") in edges(f, "returns") and ("", "external:a.b.c") in edges(f, "imports")
    assert {("", "f"), ("", "A"), ("A", "A.m"), ("A", "A.z"), ("", "X")} <= edges(f, "defines")


def test_python_code_is_the_statement():
    f = facts("m.py", "def g(): pass\nif g():\n    x = 1\n")
    [call] = [e for e in f.edges.values() if e["edge_type"] == "calls"]
    assert call["code"] == "if g():\n    x = 1" and call["location"] == "m.py:2:3"


def test_python_forward_reference_all_and_decorator():
    f = facts("m.py", "__all__ = ['late']\ndef early():\n    return late()\n@app.route('/x')\ndef late(): pass\n")
    assert ("early", "late") in edges(f, "calls") and ("", "late") in edges(f, "reads") and ("late", "late") in edges(f, "decorates")
    [d] = [json.loads(e["metadata"]) for e in f.edges.values() if e["edge_type"] == "decorates"]
    assert d == {"decorator": "app.route"}


def test_python_statements_that_nest():
    f = facts("m.py", "async def f(xs):\n    async with a() as b:\n        async for x in xs:\n            x += 1\n    try:\n        pass\n    except E as e:\n        pass\n    else:\n        h(e)\n    match xs:\n        case [y, *z]:\n            pass\n    return [w for w in xs if w], (lambda q: q)(1), (n := 2)\n")
    assert {"f.b", "f.x", "f.e", "f.y", "f.z", "f.w", "f.<lambda>", "f.<lambda>.q", "f.n"} <= set(kinds(f))
    assert ("f", "external:h") in edges(f, "calls") and ("f", "f.x") in edges(f, "writes")


def test_python_arguments():
    f = facts("m.py", "g(a, b.c, *d, 1, k=e, j=2)\n")
    [call] = [json.loads(e["metadata"]) for e in f.edges.values() if e["edge_type"] == "calls"]
    assert [(x["index"], x["name"], x["kind"]) for x in call["args"]] == [(0, "a", "name"), (1, "b", "attr"), (2, "d", "starred"), (3, "", "other"), (-1, "e", "kw"), (-1, "", "kw")]
    assert call["unknown"] is True


@pytest.mark.parametrize("source", ["def f(:", "\x00", "", "# only\n"])
def test_python_without_facts(source):
    assert list(kinds(facts("m.py", source)).values()) == ["File"]


def test_javascript():
    f = facts(
        "m.js",
        "const fs = require('fs');\nconst {a, b: c} = require('./util');\nimport d, {e as g} from 'mod';\nimport * as ns from 'all';\n"
        "function f(x, {y}, ...z) { return x; }\nclass A extends B { n = 1; m(q) { this.k(q); f(q, 2); } k(p) {} }\n"
        "const arrow = (t) => { f(t); };\nobj.meth = function (u) { return u; };\nmodule.exports = { f, A };\nexports.extra = function () {};\nnew A();\nf.call(null, 1);\n",
    )
    k = kinds(f)
    assert k["f"] == k["A.m"] == k["obj.meth"] == k["extra"] == "Function" and k["A"] == "Class" and k["A.n"] == k["arrow"] == "Variable"
    assert {"f.x", "f.y", "f.z", "arrow.t", "obj.meth.u", "c", "g", "ns"} <= set(k)
    assert {("", f"external:{x}") for x in ("fs", "./util.a", "./util.b", "mod.d", "mod.e", "all")} <= edges(f, "imports")
    assert {("A.m", "A.k"), ("A.m", "f"), ("arrow", "f"), ("", "A"), ("", "f")} <= edges(f, "calls")
    assert {("", "f"), ("", "A")} <= edges(f, "reads") and ("f", "f.x") in edges(f, "returns")


def test_javascript_arguments_count_no_punctuation():
    f = facts("m.js", "g(a, b.c, ...d, 1)\n")
    [call] = [json.loads(e["metadata"]) for e in f.edges.values() if e["edge_type"] == "calls"]
    assert [(x["index"], x["name"], x["kind"]) for x in call["args"]] == [(0, "a", "name"), (1, "b", "attr"), (2, "d", "starred"), (3, "", "other")]


@pytest.mark.parametrize("source", ["f(", "}}}", "`${", "/*", "class {", "x = /[/", "'", "function", "import", "a ? b : {", "`a${`b${c}`}`;f()"])
def test_javascript_survives(source):
    assert facts("m.js", source) is not None and facts("m.ts", source) is not None and facts("m.go", source) is not None


def test_typescript():
    f = facts(
        "m.ts",
        "interface User { id: number; name?: string; greet(p: string): void }\ntype Id = string | number;\ntype Box = { v: number };\nenum Role { Admin = 'a', User }\n"
        "abstract class S<T> implements User { private x: T; constructor(public a: string, b = 1) {} get(k: string): T | null { return this.find(k); } find(k: string): T { return null; } }\n"
        "function f(a: number, b?: string, ...c: string[]): Promise<User> { return null; }\nexport const g = async (z: Id): Promise<void> => { await f(z); };\n",
    )
    k = kinds(f)
    assert k["User"] == k["Id"] == k["Box"] == k["Role"] == k["S"] == "Class"
    assert k["User.greet"] == k["S.get"] == "Function" and {"User.id", "User.name", "Box.v", "Role.Admin", "Role.User", "S.x", "f.a", "f.b", "f.c", "g.z"} <= set(k)
    assert f.nodes["m.ts#f.b"]["type_annotation"] == "string" and f.nodes["m.ts#f"]["type_annotation"] == "Promise<User>" and f.nodes["m.ts#User.id"]["type_annotation"] == "number"
    assert ("S.get", "S.find") in edges(f, "calls") and ("g", "f") in edges(f, "calls")


def test_go():
    f = facts(
        "m.go",
        'package m\nimport "fmt"\nimport (\n\t"net/http"\n\tal "x/y"\n)\ntype User struct {\n\tID, Age int `json:"id"`\n\tName string\n}\ntype Store interface {\n\tGet(id int) (*User, error)\n}\ntype Alias = map[string]int\n'
        'var top = 1\nfunc New(a, b int, rest ...string) *User {\n\tu := &User{ID: a}\n\tfmt.Println(u, rest)\n\treturn u\n}\nfunc (u *User) Rename(name string) {\n\tu.Name = name\n\tu.touch()\n}\nfunc (u *User) touch() {\n\tif v := New(1, 2); v != nil {\n\t\tgo func(w int) { New(w, w) }(1)\n\t}\n\tswitch top {\n\tcase 1:\n\t\tNew(3, 4)\n\t}\n}\n',
    )
    k = kinds(f)
    assert k["User"] == k["Store"] == "Class" and k["Alias"] == "TypeAlias" and k["New"] == k["User.Rename"] == k["Store.Get"] == "Function"
    assert {"User.ID", "User.Age", "User.Name", "New.a", "New.b", "New.rest", "New.u", "User.Rename.u", "User.Rename.name", "top", "al"} <= set(k)
    assert f.nodes["m.go#User.ID"]["type_annotation"] == "int" and f.nodes["m.go#New.a"]["type_annotation"] == "int"
    assert {("", f"external:{x}") for x in ("fmt", "net/http", "x/y")} <= edges(f, "imports")
    assert {("New", "User"), ("New", "external:fmt.Println"), ("User.Rename", "User.touch"), ("User.touch", "New")} <= edges(f, "calls")
    assert ("New", "New.u") in edges(f, "returns") and ("User.Rename", "User.Rename.u") in edges(f, "writes")


def test_ids_of_similar_paths_differ():
    a, b = facts("a/b.py", "f()"), facts("a_b.py", "f()")
    assert not {e["id"] for e in a.edges.values()} & {e["id"] for e in b.edges.values()}


def test_registered_extractor():
    REGISTERED["toy"] = lambda f: f.node("Function", "x", (), (1, 0))
    try:
        assert kinds(extract("a.toy", "", "toy")) == {"": "File", "x": "Function"}
    finally:
        del REGISTERED["toy"]
    assert extract("a.txt", "") is None
