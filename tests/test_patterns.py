"""Patterns, rank, strong components and their cycles against brute force; hubs and long rings."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graphs, workflow

PATTERNS = {
    "triangle": [("a", "x", "b"), ("b", "x", "c"), ("a", "x", "c")],
    "ring of three": [("a", "x", "b"), ("b", "y", "c"), ("c", "x", "a")],
    "ring of four": [("a", "x", "b"), ("b", "y", "c"), ("d", "x", "c"), ("a", "y", "d")],
    "clique": [("a", "x", "b"), ("a", "x", "c"), ("a", "x", "d"), ("b", "x", "c"), ("b", "x", "d"), ("c", "x", "d")],
    "path": [("a", "x", "b"), ("b", "x", "c"), ("d", "y", "c")],
    "loop": [("a", "x", "a"), ("a", "x", "b")],
    "both ways": [("a", "x", "b"), ("b", "x", "a"), ("b", "y", "b")],
}


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "src string, rel string, dst string")


def bindings(edges, pattern):
    """One edge of the pattern after the other."""
    names, found = [], [{}]
    for x, rel, y in pattern:
        names += [v for v in (x, y) if v not in names]
        found = [{**f, x: a, y: b} for f in found for a, r, b in edges if r == rel and f.get(x, a) == a and f.get(y, b) == b and (x != y or a == b)]
    return sorted({tuple(f[n] for n in sorted(set(names))) for f in found})


@pytest.mark.parametrize("name", PATTERNS)
def test_match(spark, name):
    r = random.Random(4)
    rows = {(f"n{r.randrange(14)}", r.choice("xy"), f"n{r.randrange(14)}") for _ in range(150)}
    df = edge_table(spark, [*rows, *list(rows)[:20], (None, "x", "n1"), ("n1", None, "n2"), ("n2", "x", None)]).withColumn("a", F.lit(1))
    got = graphs.match(df, PATTERNS[name])
    assert sorted(tuple(x[c] for c in sorted(got.columns)) for x in got.collect()) == bindings(rows, PATTERNS[name])
    assert graphs.match(edge_table(spark, []), PATTERNS[name]).count() == 0


def test_unconnected_pattern(spark):
    with pytest.raises(ValueError):
        graphs.match(edge_table(spark, []), [("a", "x", "b"), ("c", "x", "d")])


def test_hub_is_not_squared(spark, monkeypatch):
    """A hub of 100,000 edges each way: rows listed stay near the number of edges, far from its square."""
    hub = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("x").alias("rel"), F.lit("hub").alias("dst"))
    back = hub.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    ring = spark.range(1_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("x").alias("rel"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    listed, real = [], graphs._listed

    def counted(*args):
        out = real(*args)
        listed.append(out.count())
        return out

    monkeypatch.setattr(graphs, "_listed", counted)
    got = graphs.match(hub.union(back).union(ring), PATTERNS["ring of three"][:1] + [("b", "x", "c"), ("c", "x", "a")])
    assert got.count() == 3 * 1_000
    assert sum(listed) < 500_000


def rank_by_hand(edges, rounds, damping=0.85):
    nodes = sorted({x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    now = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(now[n] for n in nodes if not out[n])
        now = {n: (1 - damping) / len(nodes) + damping * (sum(now[a] / len(out[a]) for a, b in edges if b == n) + loose / len(nodes)) for n in nodes}
    return now


def test_rank(spark):
    r = random.Random(8)
    rows = sorted({(f"n{r.randrange(30)}", f"n{int(30 * r.random() ** 3)}") for _ in range(90)} | {("n1", "sink")})
    df = spark.createDataFrame([*rows, *rows[:5], (None, "n1"), ("n1", None)], "src string, dst string").withColumn("rank", F.lit(1)).withColumn("node", F.lit("x"))
    got = {x["node"]: x["rank"] for x in graphs.rank(df, rounds=7, tolerance=0).collect()}
    want = rank_by_hand(rows, 7)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    last = graphs.rank(df, rounds=200, tolerance=1e-7).collect()
    assert abs(sum(x["rank"] for x in last) - 1) < 1e-9 and 7 < last[0]["rounds"] < 120
    assert graphs.rank(df.limit(0)).count() == 0


def strong_by_hand(edges):
    reach = set(edges)
    while new := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= new
    return {a: min(b for x, b in reach if x == a and (b, a) in reach) for a in {a for a, b in reach if (b, a) in reach}}


GRAPHS = {
    "ring": [(f"n{k:02}", f"n{(k + 1) % 25:02}") for k in range(25)],
    "rings that share a node": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "a"), ("d", "f"), ("g", "g")],
    "chain back to its start": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "x"), ("x", "b"), ("d", "y"), ("y", "z"), ("z", "d"), ("z", "z2")],
    "path": [(f"p{k:02}", f"p{k + 1:02}") for k in range(40)],
    "nested chains": [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "b"), ("e", "f"), ("f", "g"), ("g", "e"), ("a", "h"), ("i", "a")],
    "none": [],
    **{f"random {k}": [(f"r{a}", f"r{b}") for a, b in (random.Random(k).choices(range(30), k=2) for _ in range(20 + 8 * k))] for k in range(3)},
}


@pytest.mark.parametrize("few", [10**6, 0])
@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name, few):
    rows = GRAPHS[name]
    df = spark.createDataFrame([*rows, *rows[:3], (None, "a"), ("a", None)], "src string, dst string").withColumn("node", F.lit("x"))
    want = strong_by_hand(set(rows))
    assert {x["node"]: x["component"] for x in graphs.strong_components(df, few).collect()} == want
    cycles: dict = {}
    for x in graphs.component_cycles(df, few).collect():
        cycles.setdefault(x["component"], {})[x["position"]] = x["node"]
    assert cycles.keys() == set(want.values())
    for component, at in cycles.items():
        path = [at[k] for k in range(len(at))]
        assert len(set(path)) == len(path) and {want[n] for n in path} == {component} and path[0] == min(path)
        assert all((a, b) in set(rows) for a, b in zip(path, path[1:] + path[:1]))


def test_long_ring(spark):
    """A ring of 100,000 nodes with a long tail, on the cluster: a logarithmic number of rounds."""
    n = 100_000
    ring = spark.range(n).select(F.format_string("n%06d", "id").alias("src"), F.format_string("n%06d", (F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(3_000).select(F.format_string("t%06d", "id").alias("src"), F.when(F.col("id") == 0, "n000000").otherwise(F.format_string("t%06d", F.col("id") - 1)).alias("dst"))
    got = graphs.strong_components(ring.union(tail), 0)
    assert got.count() == n and [x["component"] for x in got.select("component").distinct().collect()] == ["n000000"]


def test_cycles_by_components(spark):
    """Cycles on the cluster no longer make pairs of nodes first."""
    rows = [(f"n{k:02}", f"n{(k + 1) % 12:02}") for k in range(12)] + [(f"a{k:02}", f"a{k + 1:02}") for k in range(30)]
    got = workflow.cycles(spark, spark.createDataFrame(rows, "node string, depends_on string"), 0)
    assert {x["root"] for x in got.collect()} == {f"n{k:02}" for k in range(12)}
