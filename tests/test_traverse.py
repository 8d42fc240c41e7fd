"""Iterative operators against plain Python on small random graphs."""

from __future__ import annotations

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphspark.operators import traverse

ARCS = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=18)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, arcs):
    return spark.createDataFrame(arcs, "src long, dst long")


def reach(arcs):
    out = defaultdict(set)
    for a, b in arcs:
        out[a].add(b)
    for k in range(8):
        for a in range(8):
            if k in out[a]:
                out[a] |= out[k]
    return out


@QUICK
@given(arcs=ARCS, depth=st.integers(0, 3))
def test_bfs_levels(spark, arcs, depth):
    level, frontier = {0: 0}, {0}
    for d in range(1, depth + 1):
        frontier = {b for a, b in arcs if a in frontier} - set(level)
        level |= dict.fromkeys(frontier, d)
    seeds = spark.createDataFrame([(0,)], "id long")
    assert {(r.id, r.depth) for r in traverse.bfs_levels(seeds, frame(spark, arcs), depth).collect()} == set(level.items())


@QUICK
@given(arcs=ARCS)
def test_strongly_connected(spark, arcs):
    arcs = [(a, b) for a, b in arcs if a != b]
    to = reach(arcs)
    expected = {(n, min(m for m in range(8) if m in to[n] and n in to[m])) for n in range(8) if n in to[n]}
    assert {(r.id, r.component) for r in traverse.strongly_connected(frame(spark, arcs)).collect()} == expected


@QUICK
@given(arcs=ARCS)
def test_simple_cycles(spark, arcs):
    arcs = {(a, b) for a, b in arcs if a != b}
    expected = set()

    def walk(path):
        for b in range(8):
            if (path[-1], b) in arcs:
                if b == path[0] and len(path) > 1:
                    expected.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 3:
                    walk([*path, b])

    for n in range(8):
        walk([n])
    found = traverse.simple_cycles(frame(spark, sorted(arcs)), 3)
    assert {tuple(r.chain) for r in found.collect()} == expected


@QUICK
@given(arcs=ARCS)
def test_dead_fixpoint(spark, arcs):
    roots = {n for n in range(8) if not any(b == n and a != n for a, b in arcs)}
    dead, depth = dict.fromkeys(roots, 0), 0
    while True:
        depth += 1
        new = {n for n in range(8) if n not in dead and (users := {a for a, b in arcs if b == n and a != n}) and users <= set(dead)}
        if not new:
            break
        dead |= dict.fromkeys(new, depth)
    nodes = spark.createDataFrame([(n,) for n in range(8)], "id long")
    got = traverse.dead_fixpoint(nodes, spark.createDataFrame([(n,) for n in sorted(roots)], "id long"), frame(spark, arcs))
    assert {(r.id, r.depth) for r in got.collect()} == set(dead.items())


def test_chains_of_any_length(spark):
    """A chain of dead symbols, and of files with an arc back, come out whole beyond a hundred rounds."""
    chain = [(n, n + 1) for n in range(110)]
    nodes = spark.createDataFrame([(n,) for n in range(111)], "id long")
    got = traverse.dead_fixpoint(nodes, nodes.limit(1).where("id = 0"), frame(spark, chain)).collect()
    assert {(r.id, r.depth) for r in got} == {(n, n) for n in range(111)}
    found = traverse.strongly_connected(frame(spark, [*chain, (110, 0), (200, 201)])).collect()
    assert {(r.id, r.component) for r in found} == {(n, 0) for n in range(111)}
