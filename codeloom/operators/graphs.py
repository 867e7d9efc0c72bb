"""Patterns, rank and strong components of graphs as joins and aggregations.

* :func:`match` finds all bindings of a pattern of typed edges, cyclic ones too. A variable is bound at a time: of the edges
  that lead to it from bound ones each row follows the one with the fewest neighbours, and the others only check
  what it finds. So a hub's neighbours are listed only where every other way is as wide, and the work is that of the best
  order for each row (a worst-case optimal join); lists of hubs are split by adaptive execution. Where the edges of
  those ways have fewer meetings (counted) than that lists nodes, they are joined with each other first.
* :func:`rank` repeats a sum over in-edges, added up before it is shuffled, so hubs get one row a task.
* :func:`strong_components` makes no pairs of nodes. Ends of trees are trimmed and chains of nodes with one edge in and one
  out become single edges by pointer doubling, so rings and paths of any length take a logarithmic number of
  rounds; in what is left colours spread forwards and are confirmed backwards, linear in the edges each round.

Nulls: edges without either end (or type) are ignored. Repeated edges count once. Empty tables give empty results. Extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime.scratch import Stored, cut, renewed, small

BROADCAST_ROWS = 100_000
#: What is left of a graph is walked on the driver where it has at most so many edges (counted; held as numbers).
FEW_EDGES = 1_000_000
TRIMS = 4
#: Rounds between which an iteration's table is stored anew.
RENEW = 5


def _kept(df: DataFrame, k: int) -> DataFrame:
    """The table of round ``k``, materialised."""
    return renewed(df) if k % RENEW == RENEW - 1 else cut(df)


# Patterns


def match(edges: DataFrame, pattern: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each binding of the pattern's variables: ``pattern`` is (variable, type, variable) for each edge.

    ``edges``: src, rel, dst. Variables may be bound to the same node. The pattern must be connected.
    """
    links = Stored(edges.select("src", "rel", "dst").dropna().distinct()).df

    def typed(rel: str, x: str, y: str) -> DataFrame:
        return links.filter(F.col("rel") == rel).select(F.col("src").alias(x), F.col("dst").alias(y))

    left = list(pattern)
    x, rel, y = left.pop(0)
    rows = typed(rel, x, y) if x != y else typed(rel, x, "__y").filter(F.col(x) == F.col("__y")).select(x)
    bound = [x, *([y] if y != x else [])]
    while left:
        inner = [e for e in left if e[0] in bound and e[2] in bound]
        for x, rel, y in inner:
            rows = rows.join(typed(rel, "__x", "__z"), (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__z")), "left_semi")
        left = [e for e in left if e not in inner]
        if not left:
            break
        ways: dict[str, list[tuple[str, str, bool]]] = {}
        for x, rel, y in left:
            if x in bound:
                ways.setdefault(y, []).append((x, rel, True))
            elif y in bound:
                ways.setdefault(x, []).append((y, rel, False))
        if not ways:
            raise ValueError("the pattern must be connected")
        # Most checks first; of equals the variable with the fewest edges to it for each node that they come from.
        most = max(map(len, ways.values()))
        able = [v for v in ways if len(ways[v]) == most]
        new = min(able, key=lambda v: min(_width(links, *way[1:]) for way in ways[v])) if len(able) > 1 else able[0]
        used = [e for e in left if (e[2] == new and e[0] in bound) or (e[0] == new and e[2] in bound)]
        sides = [typed(rel, "__from", "__to") if ahead else typed(rel, "__to", "__from") for _, rel, ahead in ways[new]]
        rows = _bound(rows, new, [x for x, _, _ in ways[new]], sides)
        bound.append(new)
        left = [e for e in left if e not in used]
    return rows.select(*bound)


def _width(links: DataFrame, rel: str, ahead: bool) -> float:
    """Edges of the type for each node that has one, in this direction."""
    n = links.filter(F.col("rel") == rel).agg(F.count("*").alias("n"), F.count_distinct("src" if ahead else "dst").alias("of")).first()
    return n["n"] / max(n["of"], 1)


def _bound(rows: DataFrame, new: str, through: list[str], sides: list[DataFrame]) -> DataFrame:
    """``rows`` with ``new`` bound to all nodes that every side (__from, __to) reaches from the variable it goes ``through``."""
    own = rows.columns
    if len(sides) == 1:
        return _listed(rows, new, through[0], sides[0]).select(*own, new)
    degrees = [side.groupBy("__from").agg(F.count("*").alias(f"__n{k}")) for k, side in enumerate(sides)]
    for k, (x, n) in enumerate(zip(through, degrees)):
        rows = rows.join(n.withColumnRenamed("__from", f"__f{k}"), F.col(x) == F.col(f"__f{k}")).drop(f"__f{k}")
    met = _meetings(sides)
    listed = rows.agg(F.sum(F.least(*[F.col(f"__n{k}") for k in range(len(sides))])).alias("n")).first()["n"] or 0
    if met <= listed:
        return _together(rows.select(own), new, through, sides)
    least = F.least(*[F.struct(F.col(f"__n{k}").alias("n"), F.lit(k).alias("k")) for k in range(len(sides))])["k"]
    rows = rows.withColumn("__least", least)
    parts = []
    for k, side in enumerate(sides):
        part = _listed(rows.filter(F.col("__least") == k), new, through[k], side)
        for j, other in enumerate(sides):
            if j != k:
                part = part.join(other, (F.col(through[j]) == F.col("__from")) & (F.col(new) == F.col("__to")), "left_semi")
        parts.append(part.select(*own, new))
    return reduce(DataFrame.union, parts)


def _meetings(sides: list[DataFrame]) -> int:
    """How many rows the sides joined on the node that they lead to would have."""
    counts = [side.groupBy("__to").agg(F.count("*").cast("double").alias(f"__m{k}")) for k, side in enumerate(sides)]
    both = reduce(lambda a, b: a.join(b, "__to"), counts)
    return both.agg(F.sum(reduce(lambda a, b: a * b, [F.col(f"__m{k}") for k in range(len(sides))])).alias("n")).first()["n"] or 0


def _together(rows: DataFrame, new: str, through: list[str], sides: list[DataFrame]) -> DataFrame:
    """As :func:`_bound`: the sides meet on ``new`` first, and each row finds its nodes by all the ways at once."""
    named = [side.select(F.col("__from").alias(f"__f{k}"), F.col("__to").alias("__new")) for k, side in enumerate(sides)]
    ways = reduce(lambda a, b: a.join(b, "__new"), named)
    met = reduce(lambda a, b: a & b, [F.col(x) == F.col(f"__f{k}") for k, x in enumerate(through)])
    return rows.join(ways, met).select(*rows.columns, F.col("__new").alias(new))


def _listed(rows: DataFrame, new: str, x: str, side: DataFrame) -> DataFrame:
    return rows.join(side.select(F.col("__from").alias("__f"), F.col("__to").alias(new)), F.col(x) == F.col("__f")).drop("__f")


# Rank


def rank(edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank, rounds): the share of random walks that are at a node; ``edges``: src, dst.

    A walk goes on along any edge, or with the probability 1 - ``damping``, and from nodes without edges out, anywhere. It
    ends after ``rounds``, or when ranks change by less than ``tolerance`` in sum.
    """
    links = edges.select("src", "dst").dropna().distinct()
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(links.select("dst", F.lit(0)))
    nodes = cut(ends.groupBy("node").agg(F.sum("out").alias("out")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"), F.lit(0).alias("rounds"))
    links = cut(links)
    now, done = nodes.select("node", "out", F.lit(1.0 / n).alias("rank")), 0
    for done in range(1, rounds + 1):
        share = now.filter("out > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        into = links.join(share, "src").groupBy("dst").agg(F.sum("share").alias("into"))
        loose = F.broadcast(now.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("loose")))  # one row
        new = (1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + F.col("loose") / n)
        both = now.join(into, F.col("node") == F.col("dst"), "left").crossJoin(loose)
        after = _kept(both.select("node", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), done)
        moved = after.agg(F.sum("change")).first()[0]
        now = after.drop("change")
        if moved < tolerance:
            break
    return now.select("node", "rank", F.lit(done).alias("rounds"))


# Strong components


def strong_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of the nodes on cycles; the component is its smallest node. ``edges``: src, dst.

    What is left after trimming is walked on the driver where it has at most ``few`` edges, else on the cluster.
    """
    links = cut(edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).dropna().distinct())
    loops = cut(links.filter("a = b").select(F.col("a").alias("node")))
    links = renewed(links.filter("a <> b"))
    chains: list[DataFrame] = []
    found = [loops.select("node", F.col("node").alias("component"))]
    while True:
        links = _trimmed(links)
        if few and links.limit(few + 1).count() <= few:
            found.append(_walked(links))
            break
        if links.isEmpty():
            break
        links, chain, rings, looped = _contracted(links)
        if chain is not None:
            chains.append(chain)
            found += [rings, looped]
            continue
        part, links = _coloured(links)
        found.append(part)
    known = cut(reduce(DataFrame.union, found).groupBy("node").agg(F.min("component").alias("component")))
    # A node of a chain is in a component if both ends are in it; chains made last are resolved first.
    for chain in reversed(chains):
        head = known.select(F.col("node").alias("first"), "component")
        tail = known.select(F.col("node").alias("last"), F.col("component").alias("other"))
        more = chain.join(head, "first").join(tail, "last").filter("component = other").select("node", "component")
        known = cut(known.union(more).groupBy("node").agg(F.min("component").alias("component")))
    # The smallest node may be one of a chain, or have been found with a loop of its own.
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def _trimmed(links: DataFrame) -> DataFrame:
    """Without edges that leave nodes without edges in, or enter nodes without edges out, a few times."""
    n = links.count()
    for _ in range(TRIMS):
        links = cut(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        before, n = n, links.count()
        if n == before:
            break
    return links


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """``links`` with chains as edges; (node, first, last) of the chains, the rings, and the nodes with a chain to themselves.

    None where too few nodes are on chains to be worth it.
    """
    out = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("f")).withColumnRenamed("a", "node")
    into = links.groupBy("b").agg(F.count("*").alias("m"), F.min("a").alias("e")).withColumnRenamed("b", "node")
    ends = cut(out.join(into, "node", "full"))
    inner = cut(ends.filter("n = 1 and m = 1").select("node", "f", "e", F.col("node").alias("least")))
    n = inner.count()
    if n * 10 < ends.count():
        return links, None, None, None
    inside = inner.select("node")
    jump = inner
    for k in range(n.bit_length() + 1):
        ahead = jump.select(F.col("node").alias("f"), F.col("f").alias("f2"), F.col("least").alias("l2"))
        back = jump.select(F.col("node").alias("e"), F.col("e").alias("e2"))
        both = jump.join(ahead, "f", "left").join(back, "e", "left")
        jump = _kept(both.select("node", F.coalesce("f2", "f").alias("f"), F.coalesce("e2", "e").alias("e"), F.least("least", F.coalesce("l2", "least")).alias("least"), F.col("f2").isNotNull().alias("open")), k)
        if jump.filter("open").isEmpty():
            break
        jump = jump.drop("open")
    closed = cut(jump.select("node", "f", "e", "least").join(inside.select(F.col("node").alias("f"), F.lit(True).alias("ring")), "f", "left"))
    rings = closed.filter("ring").select("node", F.col("least").alias("component"))
    chain = cut(closed.filter("ring is null").select("node", F.col("e").alias("first"), F.col("f").alias("last")))
    rest = links.join(inside.withColumnRenamed("node", "a"), "a", "left_anti").join(inside.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    made = chain.select(F.col("first").alias("a"), F.col("last").alias("b")).distinct()
    looped = made.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return cut(rest.union(made.filter("a <> b")).distinct()), chain, rings, looped


def _coloured(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the components that the largest node of each colour lies in, and the links without their nodes."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    colours = cut(nodes.select("node", F.col("node").alias("colour")))
    for k in count():
        into = links.join(colours.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.max("colour").alias("new"))
        both = colours.join(into.withColumnRenamed("b", "node"), "node", "left")
        colours = _kept(both.select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")), k)
        still = colours.filter("moved").isEmpty()
        colours = colours.drop("moved")
        if still:
            break
    same = links.join(colours.toDF("a", "colour"), "a").join(colours.toDF("b", "other"), "b").filter("colour = other").select("a", "b", "colour")
    same = cut(same)
    wave = cut(colours.filter("node = colour"))
    reached = wave
    for k in count():
        back = same.join(wave.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct()
        wave = _kept(back.join(reached.select("node"), "node", "left_anti"), k)
        if wave.isEmpty():
            break
        reached = _kept(reached.union(wave), k)
    gone = reached.select("node")
    rest = links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    sizes = reached.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).filter("n > 1")
    return cut(reached.join(sizes, "colour").select("node", "component")), cut(rest)


def _walked(links: DataFrame) -> DataFrame:
    """The same, on the driver: nodes as numbers in order of their names, one walk that closes a component when its first node is left."""
    table = links.toArrow()
    both = pc.unique(pa.chunked_array([*table["a"].chunks, *table["b"].chunks], pa.string()))
    names = both.take(pc.sort_indices(both.cast(pa.binary())))
    a, b = (pc.index_in(table[c], names).to_numpy() for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    to, at = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    number, low, component = [-1] * len(names), [0] * len(names), [-1] * len(names)
    met, stack, following = 0, [], at[:-1]
    for root in range(len(names)):
        walk = [root] if number[root] < 0 else []
        while walk:
            node = walk[-1]
            if number[node] < 0:
                number[node] = low[node] = met
                met += 1
                stack.append(node)
            if following[node] < at[node + 1]:
                new = to[following[node]]
                following[node] += 1
                if number[new] < 0:
                    walk.append(new)
                elif component[new] < 0:
                    low[node] = min(low[node], number[new])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[node])
            if low[node] == number[node]:
                k = len(stack) - 1
                while stack[k] != node:
                    k -= 1
                least = min(stack[k:])
                for x in stack[k:]:
                    component[x] = least
                del stack[k:]
    own = np.array(component, np.int64)
    many = np.flatnonzero(np.bincount(own, minlength=len(names))[own] > 1) if len(own) else own
    if not len(many):
        return links.sparkSession.createDataFrame([], "node string, component string")
    return links.sparkSession.createDataFrame(pa.table({"node": names.take(pa.array(many)), "component": names.take(pa.array(own[many]))}))


def component_cycles(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(component, position, node): one cycle for each strong component, from its smallest node on; ``edges``: src, dst.

    Each node goes on to its smallest successor in its component. That leads into cycles, and of each
    component the one with the smallest node is taken; its order comes from pointer doubling.
    """
    links = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).dropna().distinct()
    own = cut(strong_components(edges, few))
    inside = links.join(own.toDF("a", "component"), "a").join(own.toDF("b", "other"), "b").filter("component = other")
    step = cut(inside.groupBy("component", "a").agg(F.min("b").alias("f")).withColumnRenamed("a", "node"))
    n = step.count()
    jump = step
    for k in range(max(1, n.bit_length())):  # after n steps every walk is on its cycle
        jump = _kept(jump.join(jump.select(F.col("node").alias("f"), F.col("f").alias("f2")), "f").select("component", "node", F.col("f2").alias("f")), k)
    on = jump.select("component", F.col("f").alias("node")).distinct()
    ring = cut(step.join(on.select("node"), "node", "left_semi").select("component", "node", "f", F.col("node").alias("least")))
    for k in range(max(1, n.bit_length())):
        ahead = ring.select(F.col("node").alias("f"), F.col("f").alias("f2"), F.col("least").alias("l2"))
        ring = _kept(ring.join(ahead, "f").select("component", "node", F.col("f2").alias("f"), F.least("least", "l2").alias("least")), k)
    first = ring.groupBy("component").agg(F.min("least").alias("first"))
    mine = ring.join(first, "component").filter("least = first").select("component", "node", "first")
    # Distances to the first node by doubling: the walk stops there.
    far = cut(mine.join(step.select("node", "f"), "node").select("component", "node", "first", F.col("f"), F.lit(1).cast("long").alias("steps")))
    for k in range(max(1, n.bit_length())):
        ahead = far.select(F.col("node").alias("f"), F.col("f").alias("f2"), F.col("steps").alias("s2"))
        both = far.join(ahead, "f", "left")
        go = F.col("f") != F.col("first")
        far = _kept(both.select("component", "node", "first", F.when(go, F.col("f2")).otherwise(F.col("f")).alias("f"), F.when(go, F.col("steps") + F.col("s2")).otherwise(F.col("steps")).alias("steps")), k)
    length = small(far.groupBy("component").agg(F.max("steps").alias("length")), BROADCAST_ROWS)
    return far.join(length, "component").select("component", (F.col("length") - F.col("steps")).alias("position"), "node")
