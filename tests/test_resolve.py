"""Rules of call resolution that the tables can't reach, on small graphs."""

from __future__ import annotations

from graphspark.operators import resolve
from graphspark.schema import EDGE, NODE

NODES = [
    ("a.py#f", "Function", "f", "a.py"), ("a.py#Own.m", "Function", "m", "a.py:Own"), ("pkg/mod.py#K.only_method", "Function", "only_method", "pkg/mod.py:K"),
    ("pkg/mod.py#Klass", "Class", "Klass", "pkg/mod.py"), ("pkg.py#mod.Klass", "Class", "Klass", "pkg.py:mod"), ("other/mod.py#Klass", "Class", "Klass", "other/mod.py"),
    ("web/x.js#T.only_method", "Function", "only_method", "web/x.js:T"), ("a.py#twin", "Function", "twin", "a.py"), ("b.py#twin", "Function", "twin", "b.py"), ("pkg/__init__.py#start", "Function", "start", "pkg/__init__.py"),
]


def resolved(spark, edges):
    nodes = spark.createDataFrame([(i, k, n, f"{i.split('#')[0]}:1:0", "", s, "", "", 0) for i, k, n, s in NODES], NODE)
    rows = [(str(no), kind, source, f"#external:{to}", f"a.py:{no + 1}:0", "", "{}", f"#external:{to}") for no, (kind, source, to) in enumerate(edges)]
    return {int(r.id): (r.target, r["rank"]) for r in resolve.resolve_calls(nodes, spark.createDataFrame(rows, EDGE)).collect()}


def test_methods_of_any_class_stay_within_a_language(spark):
    assert resolved(spark, [("calls", "a.py#f", "obj.only_method"), ("calls", "b.go#g", "obj.only_method")]) == {0: ("pkg/mod.py#K.only_method", 7)}


def test_longest_module_path_of_an_imported_name(spark):
    found = resolved(spark, [("imports", "a.py#", "pkg.mod"), ("calls", "a.py#f", "mod.Klass"), ("imports", "c.py#", "pkg"), ("calls", "c.py#g", "pkg.mod.Klass"), ("calls", "d.py#h", "mod.Klass")])
    assert found == {1: ("pkg/mod.py#Klass", 9), 3: ("pkg/mod.py#Klass", 9)}


def test_other_files_come_first_and_own_scope_before_all(spark):
    found = resolved(spark, [("calls", "z.py#g", "x.twin"), ("calls", "a.py#Own.n", "this.m"), ("calls", "a.py#Own.n", "Own.m"), ("calls", "a.py#f", "x.y.twin"), ("calls", "b.py#g", "twin"), ("calls", "a.py#Own.n.inner", "x.m")])
    assert found == {0: ("a.py#twin", 6), 1: ("a.py#Own.m", 0), 2: ("a.py#Own.m", 1), 3: ("a.py#twin", 4), 4: ("b.py#twin", 8), 5: ("a.py#Own.m", 3)}


def test_packages_go_by_their_folder(spark):
    assert resolved(spark, [("imports", "a.py#", "pkg"), ("calls", "a.py#f", "pkg.start")]) == {1: ("pkg/__init__.py#start", 2)}


def test_homonyms_meet_calls_once(spark):
    """The counts of all pairs of calls and functions, without a join that makes them."""
    files = [f"f{k}.py" for k in range(4)]
    names = [(f"{files[k % 4] if k % 5 else files[0]}#n{k}", f"fn{k % 3}") for k in range(60)] + [("f1.py#only", "only")]
    nodes = spark.createDataFrame([(i, "Function", n, "", "", i.split("#")[0], "", "", 0) for i, n in [*names, names[0]]], NODE)
    calls = [(f"c{k % 180}", f"{files[k % 3]}#g", f"fn{k % 4}" if k % 7 else "only") for k in range(200)] + [(None, "f1.py#g", "only"), (None, "f0.py#g", "fn0"), ("lost", None, "fn1")]
    edges = spark.createDataFrame([(i, "calls", f, "", "", "", "{}", f"#external:{t}") for i, f, t in calls], EDGE)
    expected = {}
    for i, f, t in calls:
        for target, name in names:
            if name == t:
                hits, others = expected.setdefault(i, (set(), set()))
                hits.add(target)
                if f and f.split("#")[0] != target.split("#")[0]:
                    others.add(target)
    found = resolve.homonyms(nodes, edges)
    assert {r.id: (r.homonyms, r.elsewhere) for r in found.collect()} == {i: (len(h), min(o, default=None)) for i, (h, o) in expected.items()}
    joins = [x for x in plan_rows(found) if x[0].endswith("Join")]
    assert joins and all(n <= len(calls) for _, n in joins)


def plan_rows(df):
    """Names and output rows of the operators of an executed plan."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            out.append((node.nodeName(), metric.get().value()))
        todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return out
