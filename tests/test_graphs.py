"""Graph operators against brute force: on the driver and on the cluster, without limits of depth."""

import random

import pytest

from codeloom.operators import workflow

PATHS = [10**6, 0]


def frame(spark, rows, names="node string, requires string"):
    return spark.createDataFrame(rows, names)


def levels_by_hand(edges):
    nodes = {x for e in edges for x in e if x is not None}
    needs = {n: {b for a, b in edges if a == n and b is not None} for n in nodes}
    out = {}
    while wave := [n for n in nodes - out.keys() if needs[n] <= out.keys()]:
        level = max(out.values(), default=0) + 1
        out |= dict.fromkeys(wave, level)
    return out


def reach_by_hand(edges):
    edges = [e for e in edges if None not in e]
    pairs = set(edges)
    while new := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= new
    return pairs


def cycles_by_hand(edges):
    edges = sorted({e for e in edges if None not in e})
    out = {}
    for root in {a for a, _ in edges}:
        paths, seen = {root: root}, set()
        while paths and root not in out:
            found = {}
            for n, p in paths.items():
                for a, b in edges:
                    if a == n and b not in seen:
                        found[b] = min(found.get(b, f"{p} -> {b}"), f"{p} -> {b}")
            seen |= found.keys()
            if root in found:
                out[root] = found[root]
            paths = found
    return out


GRAPHS = {
    "ring": [(f"n{k:02}", f"n{(k + 1) % 25:02}") for k in range(25)],
    "rings that share a node": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "a"), ("d", "f"), ("g", "g")],
    "layers": [(f"{k}.{i}", f"{k - 1}.{j}") for k in range(1, 12) for i in range(4) for j in range(4)],
    "nulls": [("a", None), (None, "b"), ("c", "a"), (None, None), ("d", None)],
    "copies": [("a", "b")] * 3 + [("b", "c")] * 2,
    "random": [(f"r{a}", f"r{b}") for a, b in (random.Random(3).choices(range(40), k=2) for _ in range(50))],
}


@pytest.mark.parametrize("few", PATHS)
@pytest.mark.parametrize("name", GRAPHS)
def test_levels(spark, name, few):
    got = {r["node"]: r["level"] for r in workflow.levels(spark, frame(spark, GRAPHS[name]), few).collect()}
    assert got == levels_by_hand(GRAPHS[name])


@pytest.mark.parametrize("few", PATHS)
@pytest.mark.parametrize("name", GRAPHS)
def test_cycles(spark, name, few):
    found = workflow.cycles(spark, frame(spark, GRAPHS[name], "node string, depends_on string"), few).collect()
    assert {r["root"]: r["path"] for r in found} == cycles_by_hand(GRAPHS[name])


@pytest.mark.parametrize("name", GRAPHS)
def test_closure(spark, name):
    found = workflow.closure(spark, frame(spark, GRAPHS[name], "node string, depends_on string")).collect()
    assert sorted(map(tuple, found)) == sorted(reach_by_hand(GRAPHS[name]))


def test_long_chains(spark):
    chain = [(f"n{k:03}", f"n{k - 1:03}") for k in range(1, 131)]
    assert workflow.levels(spark, frame(spark, chain)).selectExpr("max(level)").first()[0] == 131
    assert workflow.closure(spark, frame(spark, chain, "node string, depends_on string")).count() == 130 * 131 // 2
    short = [e for e in chain if e[0] <= "n030"]
    assert workflow.levels(spark, frame(spark, short), 0).selectExpr("max(level)").first()[0] == 31


def test_no_edges(spark):
    none = frame(spark, [])
    assert workflow.levels(spark, none).count() == workflow.levels(spark, none, 0).count() == 0
    none = frame(spark, [], "node string, depends_on string")
    assert workflow.cycles(spark, none).count() == workflow.cycles(spark, none, 0).count() == workflow.closure(spark, none).count() == 0
