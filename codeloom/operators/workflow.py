"""Workflow state as relations: readiness, conditions, levels, history."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import graphs
from codeloom.runtime.scratch import cut, renewed, small

FINISHED = ("completed", "skipped")
STALL_SECONDS = 3600
MAX_RUNNING = 10
#: Graphs of at most so many edges are walked on the driver.
FEW_EDGES = 5_000
#: Edges on cycles that each task may hold.
WALKED_EDGES = 100_000
ARROW = " -> "
#: Rounds between which an iteration's table is stored anew.
RENEW = 5
#: Above all levels: that of nodes which are never ready.
NEVER = 2**31 - 1


def finished(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status").isin(*FINISHED))


def ready(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Steps without a result all of whose required steps have finished (relational division by one aggregation)."""
    known = results.groupBy("workflow_id", "step").agg(F.bool_or(F.col("status").isin(*FINISHED)).alias("done"))
    asked = steps.select("workflow_id", "step", "requires").join(known.withColumnRenamed("step", "requires"), ["workflow_id", "requires"], "left")
    met = asked.groupBy("workflow_id", "step").agg(F.bool_and(F.col("requires").isNull() | F.coalesce("done", F.lit(False))).alias("met"))
    return met.filter("met").join(known, ["workflow_id", "step"], "left_anti").select("workflow_id", "step")


def pending(steps: DataFrame, results: DataFrame) -> DataFrame:
    return steps.join(finished(results), ["workflow_id", "step"], "left_anti").select("workflow_id", "step")


def unknown_requirements(steps: DataFrame) -> DataFrame:
    names = steps.select("workflow_id", F.col("step").alias("requires"))
    return steps.filter("requires is not null").join(names, ["workflow_id", "requires"], "left_anti").select("workflow_id", "step", "requires")


def duplicate_steps(steps: DataFrame, *key: str) -> DataFrame:
    return steps.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def inputs(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Each required step's output: its data, else its raw result; ``error`` where there is none."""
    out = results.select("workflow_id", F.col("step").alias("requires"), F.coalesce("data", "result").alias("input"))
    joined = steps.filter("requires is not null").join(out, ["workflow_id", "requires"], "left")
    return joined.select("workflow_id", "step", "requires", "input", F.col("input").isNull().alias("error"))


def conditions(steps: DataFrame) -> DataFrame:
    """Whether a step runs under its condition, given its required step's status.

    The steps are read once. Each asks at the step that it requires, where its condition depends on one, and tells its
    own status there, unless it has completed: only 1 (not completed) and 2 (failed) change an answer.
    """
    c, status = F.col("condition"), F.col("status")
    asks = F.coalesce(c.isin("on_success", "on_failure") & F.col("requires").isNotNull(), F.lit(False))
    asked = F.struct(F.when(asks, F.col("requires")).otherwise(F.col("step")).alias("at"), "step", "condition", F.when(asks, 0).otherwise(-1).alias("told"))
    told = F.struct(F.col("step").alias("at"), F.lit(None).alias("step"), F.lit(None).alias("condition"), F.when(status == "failed", 2).otherwise(1).alias("told"))
    # Unknown steps and workflows are nobody's requirement.
    tells = (status != "completed") & F.col("workflow_id").isNotNull() & F.col("step").isNotNull()
    rows = steps.select("workflow_id", F.inline(F.when(tells, F.array(asked, told)).otherwise(F.array(asked))))
    worst = F.max("told").over(Window.partitionBy("workflow_id", "at"))
    heard = rows.withColumn("worst", worst).filter("told <= 0")
    hit = (F.col("told") == 0) & F.when(c == "on_success", F.col("worst") >= 1).otherwise(F.col("worst") == 2)
    runs = F.when(c == "on_failure", F.bool_or(hit)).otherwise(~F.bool_or(hit))
    return heard.groupBy("workflow_id", "step", "condition").agg(runs.alias("runs"))


def final_status() -> Column:
    return F.when(F.bool_or((F.col("status") == "failed") & F.col("critical")), "failed").otherwise("completed")


def _links(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) without nulls."""
    return edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().distinct()


def _few(edges: DataFrame, most: int) -> list[tuple[str, str]] | None:
    """The edges on the driver where there are at most ``most``, else None."""
    rows = edges.limit(most + 1).collect()
    return sorted(map(tuple, rows)) if len(rows) <= most else None


def levels(spark, edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, level) by longest path from a node without requirements; edges are (node, requires).

    A null ``requires`` stands for a node without requirements, so isolated nodes are at level 1. Nodes on a
    cycle, and those that need one, are never ready and left out. Levels are peeled one by one, however many
    there are: on the driver for at most ``few`` edges, else in rounds on the cluster.
    """
    links = cut(_links(edges, "node", "requires"))
    nodes = edges.select(F.col("node").cast("string").alias("node")).union(edges.select(F.col("requires").cast("string"))).dropna()
    own = _few(links, few)
    if own is not None and (names := nodes.distinct().limit(2 * few + 1).collect()) and len(names) <= 2 * few:
        return spark.createDataFrame(_peeled([r["node"] for r in names], own), "node string, level int")
    found, level, n = [nodes.withColumn("level", F.lit(1))], 1, links.count()
    while n:
        # A link is met in the round in which the node that it requires waits for none; its own node is a level higher at least.
        waiting = links.select(F.col("a").alias("b")).distinct().withColumn("waits", F.lit(True))
        both = links.join(waiting, "b", "left")
        both, level = renewed(both) if level % RENEW == 0 else cut(both), level + 1
        found.append(both.filter("waits is null").select(F.col("a").alias("node"), F.lit(level).alias("level")))
        links = both.filter("waits").select("a", "b")
        before, n = n, links.count()
        if n == before:
            break
    found.append(links.select(F.col("a").alias("node"), F.lit(NEVER).alias("level")))
    return reduce(DataFrame.union, found).groupBy("node").agg(F.max("level").alias("level")).filter(F.col("level") < NEVER)


def _peeled(nodes: list[str], links: list[tuple[str, str]]) -> list[tuple[str, int]]:
    waits, followers = dict.fromkeys(nodes, 0), {}
    for a, b in links:
        waits[a] += 1
        followers.setdefault(b, []).append(a)
    wave, level, out = [n for n, k in waits.items() if not k], 0, []
    while wave:
        level += 1
        out += [(n, level) for n in wave]
        following = []
        for n in wave:
            for a in followers.get(n, ()):
                waits[a] -= 1
                if not waits[a]:
                    following.append(a)
        wave = following
    return out


def closure(spark, edges: DataFrame) -> DataFrame:
    """(root, node) for all nodes that a node depends on, directly or not; edges are (node, depends_on).

    Each round adds the pairs at up to twice the distance: those at the largest distance so far, with all that their ends
    reach. So the rounds grow with the logarithm of the longest path, a pair is found once for each node half way on its shortest paths,
    and is written once.
    """
    links = _links(edges, "node", "depends_on")
    parts, most = [cut(links.select(F.col("a").alias("root"), F.col("b").alias("node"), F.lit(1).alias("distance")))], 1
    while True:
        reach = reduce(DataFrame.union, parts)
        far = parts[-1].filter(F.col("distance") == most).select("root", F.col("node").alias("through"))
        ahead = reach.select(F.col("root").alias("through"), "node", "distance")
        further = far.join(ahead, "through").groupBy("root", "node").agg((F.min("distance") + most).alias("distance"))
        further = further.join(reach.select("root", "node"), ["root", "node"], "left_anti")
        new = renewed(further) if len(parts) % RENEW == 0 else cut(further)
        if new.isEmpty():
            return reach.select("root", "node")
        parts.append(new)
        most *= 2


def cycles(spark, edges: DataFrame, few: int = FEW_EDGES, walked: int = WALKED_EDGES) -> DataFrame:
    """(root, path): nodes that reach themselves, with a shortest such path, of equals the first; edges are (node, depends_on).

    Cycles may be of any length. Paths are searched among the nodes on cycles only, and of the paths to one node
    the first is carried on: on the driver for at most ``few`` edges. Of larger graphs the edges within components go to all tasks where
    there are at most ``walked`` (counted), and each task walks from its roots; beyond that, paths grow in rounds on the cluster.
    """
    links = _links(edges, "node", "depends_on")
    own = _few(links, few)
    if own is not None:
        return spark.createDataFrame(_loops(own), "root string, path string")
    links = cut(links)
    own = small(graphs.strong_components(links.toDF("src", "dst"), graphs.FEW_EDGES if walked else 0), walked)
    both = links.join(own.toDF("a", "component"), "a").join(own.toDF("b", "other"), "b")
    links = cut(both.filter("component = other").select("a", "b"))
    own = _few(links, walked)
    if own is not None:
        held = spark.sparkContext.broadcast(own)
        parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return links.select("a").distinct().repartition(parts, "a").mapInArrow(partial(_rooted, held=held), "root string, path string")
    return _grown(links)


def _grown(links: DataFrame) -> DataFrame:
    """The cycles of links (a, b) within components, one step a round."""
    walk = cut(links.select(F.col("a").alias("root"), F.col("b").alias("node"), F.concat("a", F.lit(ARROW), "b").alias("path")))
    seen, out = walk.select("root", "node"), walk.filter("root = node").select("root", "path")
    while True:
        step = walk.filter("root <> node").join(links.select(F.col("a").alias("node"), "b"), "node")
        step = step.groupBy("root", "b").agg(F.min(F.concat("path", F.lit(ARROW), "b")).alias("path")).withColumnRenamed("b", "node")
        walk = cut(step.join(seen, ["root", "node"], "left_anti"))
        if walk.isEmpty():
            return out
        out = out.union(walk.filter("root = node").select("root", "path"))
        seen = cut(seen.union(walk.select("root", "node")))


def _rooted(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    to = _followers(held.value)
    for b in batches:
        for root in b.column(0).to_pylist():
            path = _loop(root, to)
            if path is not None:
                yield pa.RecordBatch.from_pydict({"root": [root], "path": [path]})


def _followers(links: list[tuple[str, str]]) -> dict[str, list[str]]:
    to: dict[str, list[str]] = {}
    for a, b in links:
        to.setdefault(a, []).append(b)
    return to


def _text(step: tuple | None) -> str:
    """The path of a chain of (step before, node)."""
    names = []
    while step:
        step, name = step
        names.append(name)
    return ARROW.join(reversed(names))


def _loop(root: str, to: dict[str, list[str]]) -> str | None:
    """The first of the shortest paths from ``root`` back to it; paths are written out only where two meet."""
    wave: dict[str, tuple] = {root: (None, root)}
    seen: set[str] = set()
    while wave and root not in seen:
        following: dict[str, tuple] = {}
        for node, step in wave.items():
            for b in to.get(node, ()):
                if b not in seen and (b not in following or _text((step, b)) < _text(following[b])):
                    following[b] = (step, b)
        seen |= following.keys()
        wave = following
    return _text(wave[root]) if root in wave else None


def _loops(links: list[tuple[str, str]]) -> list[tuple[str, str]]:
    while True:  # only what has a way in and a way out can be on a cycle
        heads, tails = {a for a, _ in links}, {b for _, b in links}
        kept = [(a, b) for a, b in links if a in tails and b in heads]
        if len(kept) == len(links):
            break
        links = kept
    to = _followers(links)
    return [(root, path) for root in to if (path := _loop(root, to)) is not None]


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` runs of each name, with their place in time order."""
    new = Window.partitionBy("name").orderBy(F.desc("start_time"), F.desc("workflow_id"))
    old = Window.partitionBy("name").orderBy("start_time", "workflow_id")
    kept = runs.withColumn("r", F.row_number().over(new)).filter(F.col("r") <= n).drop("r")
    return kept.withColumn("position", F.row_number().over(old))


def running_at(starts: DataFrame, key: str) -> DataFrame:
    """How many runs of a key are open just after each start or end: a running sum of +1 and -1."""
    both = starts.select(key, F.col("start_time").alias("moment"), F.lit(1).alias("step")).union(starts.select(key, F.col("end_time"), F.lit(-1)))
    w = Window.partitionBy(key).orderBy("moment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.groupBy(key, "moment").agg(F.sum("step").alias("step")).withColumn("running", F.sum("step").over(w)).drop("step")
