"""Decayed sums and samples, in batches too, and code clones against brute force on real sources."""

import ast
import collections
import datetime
import glob
import math
import os
import random

from pyspark.sql import functions as F

import codeloom
from codeloom.operators import clones, decay

START = datetime.datetime(2024, 1, 1)
HALF = 40_000.0


def events(spark, n=400):
    r = random.Random(6)
    rows = [(k, START + datetime.timedelta(seconds=r.randrange(5 * 86_400)), r.choice("ab"), r.choice([None, 1.0, 2.5])) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None, "a", 1.0)], "event_id long, ts timestamp, kind string, value double").withColumn("day", F.lit("x"))


def test_decayed_sums(spark):
    rows, df = events(spark)
    whole = decay.state(df, HALF, "kind")
    parts = [decay.state(df.filter(F.col("event_id") % 3 == k), HALF, "kind") for k in range(3)]
    end = START.timestamp() // 86_400 * 86_400 + 5 * 86_400
    for s in (whole, decay.merged(parts[0].union(parts[1]).union(parts[2]), "kind")):
        got = {x["kind"]: x for x in decay.read(s, HALF, int(end // 86_400) - 1, "kind").collect()}
        for kind in "ab":
            own = [(0.5 ** ((end - t.timestamp()) / HALF), v) for _, t, c, v in rows if c == kind]
            assert got[kind]["n"] == len(own) and math.isclose(got[kind]["weight"], sum(w for w, _ in own)) and math.isclose(got[kind]["total"], sum(w * (v or 0) for w, v in own))
    assert decay.read(decay.state(df.limit(0), HALF, "kind"), HALF, 1, "kind").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Each micro-batch appends its state; the merged states are those of all events."""
    _, df = events(spark)
    df.drop("day").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.drop("day").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(lambda b, n: decay.state(b, HALF, "kind").write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x["kind"], x["day"]): x for x in decay.merged(spark.read.parquet(f"{tmp_path}/out"), "kind").collect()}
    want = {(x["kind"], x["day"]): x for x in decay.state(df, HALF, "kind").collect()}
    assert got.keys() == want.keys() and all(got[k]["n"] == want[k]["n"] and math.isclose(got[k]["total"], want[k]["total"]) for k in want)


def test_decayed_sample(spark):
    """The same rows however they are dealt, and younger ones more often."""
    _, df = events(spark, 4000)
    one = decay.sample(df, HALF, 200)
    parts = [decay.sample(df.filter(F.col("event_id") % 3 == k), HALF, 200) for k in range(3)]
    ids = lambda x: [r["event_id"] for r in x.collect()]
    assert ids(one) == ids(decay.top(parts[0].union(parts[1]).union(parts[2]), 200))
    days = collections.Counter((r["ts"] - START).days for r in one.collect())
    assert len(ids(one)) == 200 and days[4] > 3 * days[3] > 0


def hashed(node):
    """A tree as nested tuples, without names."""
    label = ("Constant", type(node.value).__name__) if isinstance(node, ast.Constant) else (type(node).__name__,)
    return (*label, tuple(hashed(x) for x in ast.iter_child_nodes(node)))


def test_clones_on_real_sources(spark):
    paths = sorted(glob.glob(os.path.join(os.path.dirname(codeloom.__file__), "operators", "*.py")))[:14]
    files = [(p, open(p).read()) for p in paths]
    copy = files[3][1].replace("def ", "def other_").replace("spark", "session")
    files += [("copy.py", copy), ("broken.py", "def"), ("empty.py", None), ("same.txt", files[0][1])]
    rows = []
    for path, text in files:
        if path in ("broken.py", "empty.py", "same.txt"):
            continue

        def walk(node, up):
            size = sum(1 for _ in ast.walk(node))
            mine = isinstance(node, (ast.stmt, ast.Module)) and size >= 12
            key = hashed(node) if mine else None
            if mine:
                rows.append((path, size, key, up))
            for child in ast.iter_child_nodes(node):
                walk(child, key if mine else up)

        walk(ast.parse(text), None)
    n = collections.Counter(r[2] for r in rows)
    want = collections.Counter((p, size, n[key]) for p, size, key, up in rows if n[key] > 1 and n[up] < 2)
    got = clones.clones(spark.createDataFrame(files, "path string, content string").withColumn("hash", F.lit(1)))
    found = collections.Counter((r["path"], r["nodes"], r["copies"]) for r in got.collect())
    assert found == want and ("copy.py", max(s for p, s, _ in want if p == "copy.py"), 2) in want
    assert clones.clones(spark.createDataFrame([], "path string, content string")).count() == 0
