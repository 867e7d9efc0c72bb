"""That the work of an operator is shared out, whatever the tables look like."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from codeloom.operators import clones, entities, graphs, vectors, workflow
from codeloom.plans import views as v


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sources(spark, d):
    spark.range(1, 41, 1, 1).select(F.col("id").cast("int").alias("p_partkey")).write.parquet(f"{d}/part.parquet")
    return v.nested(spark, d)


def test_parsing_is_spread(spark, tmp_path):
    files = _sources(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 1
    found = entities.extract(files)
    busy = found.select("path", F.spark_partition_id().alias("p")).distinct()
    assert busy.select("p").distinct().count() > 4 and busy.count() == 40
    assert clones.clones(files).select("path").distinct().count() == 40


def test_graph_parses_once_and_broadcasts_nothing(spark, tmp_path):
    files = _sources(spark, str(tmp_path))
    edges = entities.graph(entities.extract(files))[1]
    assert _plan(edges).count("MapInArrow") == 1 and "Broadcast" not in _plan(edges)
    assert edges.count() == edges.union(edges).distinct().count() == 40 * 18
    counted = entities.metrics(files, entities.extract(files))
    assert "Broadcast" not in _plan(counted) and counted.count() == 40


def test_graph_of_repeated_paths(spark):
    both = [("a.py", "def f():\n    g()\n"), ("a.py", "def g():\n    h()\n"), ("a.py", "def f():\n    g()\n")]
    nodes, edges = entities.graph(entities.extract(spark.createDataFrame(both, "path string, content string")))
    assert {tuple(r) for r in edges.collect()} == {("a.py", "CONTAINS", "a.py::f"), ("a.py", "CONTAINS", "a.py::g"), ("a.py::f", "CALLS", "a.py::g"), ("a.py::g", "CALLS", "h")}
    assert edges.count() == 4 and nodes.count() == 4


def test_long_cycles_take_few_jobs(spark):
    """Six rings with a tail each, more edges than the driver lists: before, a round for each step of the rings."""
    rows = [(f"{r}-{k:04}", f"{r}-{(k + 1) % 1001:04}") for r in range(6) for k in range(1001)] + [(f"t{r}", f"{r}-0000") for r in range(6)]
    edges = spark.createDataFrame(rows, "node string, depends_on string")
    spark.sparkContext.setJobGroup("rings", "rings")
    found = {x["root"]: x["path"] for x in workflow.cycles(spark, edges).collect()}
    own = {x["node"]: x["component"] for x in graphs.strong_components(edges.toDF("src", "dst")).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rings")) < 200
    assert found.keys() == own.keys() == {a for a, _ in rows if a[0] != "t"} and all(own[x] == f"{x[0]}-0000" for x in own)
    for x in ("0-0000", "5-0700"):
        k, names = int(x[2:]), found[x].split(" -> ")
        assert names == [f"{x[0]}-{(k + i) % 1001:04}" for i in range(1002)]


def _cuts(monkeypatch):
    """The tables that rounds store."""
    stored, cut = [], workflow.cut
    monkeypatch.setattr(workflow, "cut", lambda df: (stored.append(cut(df)), stored[-1])[1])
    return stored


def test_closure_stores_a_pair_once(spark, monkeypatch):
    """A path of 17 nodes: before, each round stored what was reached again."""
    stored = _cuts(monkeypatch)
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(16)], "node string, depends_on string")
    assert workflow.closure(spark, edges).count() == sum(x.count() for x in stored) == 16 * 17 // 2


def test_closure_of_random_graphs(spark):
    r = random.Random(9)
    for nodes, links in ((12, 14), (30, 60), (40, 42)):
        rows = sorted({(f"p{r.randrange(nodes)}", f"p{r.randrange(nodes)}") for _ in range(links)})
        want = set(rows)
        while more := {(a, d) for a, b in want for c, d in rows if b == c} - want:
            want |= more
        got = workflow.closure(spark, spark.createDataFrame(rows, "node string, depends_on string")).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_levels_store_links_only(spark, monkeypatch):
    """A table a round, of the links that are left: before, three, of nodes and links."""
    stored = _cuts(monkeypatch)
    rows = [(f"{k}-{n}", f"{k}-{n - 1}" if n else None) for k in range(20) for n in range(4)] + [("x", "y"), ("y", "x"), ("z", "x"), ("z", "1-3"), ("w", "0-0"), ("w", "0-2")]
    got = {tuple(x) for x in workflow.levels(spark, spark.createDataFrame(rows, "node string, requires string"), 0).collect()}
    assert got == {(f"{k}-{n}", n + 1) for k in range(20) for n in range(4)} | {("w", 4)}
    assert len(stored) <= 5 and sum(x.count() for x in stored) <= 66 + 66 + 45 + 25 + 4


def test_ways_of_walking_agree(spark):
    """On the driver, in tasks and in rounds, with ties and names that begin others."""
    r = random.Random(5)
    rows = [(f"p{r.randrange(25)}", f"p{r.randrange(25)}") for _ in range(45)]
    edges = spark.createDataFrame(rows, "node string, depends_on string")
    ways = [{tuple(x) for x in workflow.cycles(spark, edges, *of).collect()} for of in ((), (0,), (0, 0))]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 5


def test_squares_list_no_sellers_of_a_part(spark, monkeypatch):
    """A part that 60 sell and 60 buy, all of nations of their own but for pairs: 60 rows, and no step with 60 * 60."""
    rows = [(f"c{k}", "ORDERED", "p") for k in range(60)] + [(f"s{k}", "SUPPLIES", "p") for k in range(60)]
    rows += [(f"{x}{k}", "LIVES_IN", f"n{k}") for k in range(60) for x in "cs"]
    edges, seen = spark.createDataFrame(rows, "src string, rel string, dst string"), []
    listed = graphs._listed
    monkeypatch.setattr(graphs, "_listed", lambda *a: (seen.append(listed(*a)), seen[-1])[1])
    got = graphs.match(edges, [("c", "ORDERED", "p"), ("s", "SUPPLIES", "p"), ("c", "LIVES_IN", "n"), ("s", "LIVES_IN", "n")])
    assert {tuple(r) for r in got.select("c", "p", "s", "n").collect()} == {(f"c{k}", "p", f"s{k}", f"n{k}") for k in range(60)} and got.count() == 60
    assert max(x.count() for x in seen) == 60


def test_neighbors_are_exact_where_the_index_misses(spark, monkeypatch):
    """An index that probes one list finds too few, and its result is made whole."""
    r = random.Random(3)
    rows = vectors.usable(spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(16)]) for k in range(3000)], "vec_id long, embedding array<double>"))
    asked, fit = rows.filter("id % 100 = 0"), vectors.fit
    monkeypatch.setattr(vectors, "fit", lambda x: replace(fit(x), probes=1))
    index = vectors.fit(rows)
    want = {tuple(x) for x in vectors.exact(rows, asked).collect()}
    near = {tuple(x) for x in vectors.search(rows, vectors.build(rows, index), index, asked).collect()}
    assert near != want and {tuple(x) for x in vectors.neighbors(rows, asked).collect()} == want


def test_conditions_read_steps_once(spark, tmp_path):
    """Before, steps were aggregated for both sides of a join, and one task held both, two sorts and a third table."""
    d = str(tmp_path)
    line = spark.range(60).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"), F.substring(F.lit("RAN"), (F.col("id") % 3 + 1).cast("int"), F.lit(1)).alias("l_returnflag"))
    line.withColumns({"l_linestatus": F.lit("F"), "l_shipdate": F.current_timestamp(), "l_quantity": F.lit(1.0)}).write.parquet(f"{d}/lineitem.parquet")
    got = workflow.conditions(v.steps(spark, d).withColumn("condition", F.lit("on_success")))
    assert got.count() == 60 and _plan(got).count("FileScan") == 1 and "Join" not in _plan(got)


def test_conditions_by_hand(spark):
    """Several requirements, unknown ones, nulls, repeated steps, one step that all require."""
    r = random.Random(11)
    some = lambda *of: r.choice(of)
    rows = [(some(1, 2, 3, None), some(*range(12), None), some(*range(14), None), some("completed", "completed", "failed", "skipped", None), some("on_success", "on_failure", "always", "other", None)) for _ in range(700)]
    rows += [(9, k, 0, some("completed", "failed"), some("on_success", "on_failure")) for k in range(60)]
    rows += [(8, k, k - 1 if k else None, some("completed", "failed", None), some("on_success", "on_failure")) for k in range(60)]
    want = {}
    for w, step, requires, _, c in rows:
        found = [s for a, b, _, s, _ in rows if w is not None and requires is not None and (a, b) == (w, requires) and s]
        want.setdefault((w, step, c), []).extend(found)
    want = {(*k, all(s == "completed" for s in v) if k[2] == "on_success" else "failed" in v if k[2] == "on_failure" else True) for k, v in want.items()}
    steps = spark.createDataFrame(rows, "workflow_id long, step int, requires int, status string, condition string")
    got = workflow.conditions(steps)
    assert got.schema.simpleString() == "struct<workflow_id:bigint,step:int,condition:string,runs:boolean>"
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
