"""Ranked search and versions against brute force, what they skip, and edge cases."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import entities, textsearch, versions


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("block", F.lit(1))


def ranked(rows, words, k):
    own = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows]
    average = sum(len(w) for _, w in own) / len(own)
    out = []
    for i, w in own:
        n, s = collections.Counter(w), 0.0
        for q in set(words):
            df = sum(q in x for _, x in own)
            s += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * n[q] * 2.2 / (n[q] + 1.2 * (0.25 + 0.75 * len(w) / average)) if df else 0
        if set(words) & set(w):
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("block", [1000, 7])
def test_search(spark, block):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "Eps", "x1"], [9, 5, 3, 1, 0.3, 2], k=r.randint(0, 60)))) for k in range(150)] + [(900, None), (901, " "), (902, "alpha " * 500)]
    index = textsearch.Index(docs_of(spark, rows).repartition(3), block)
    for words in (["alpha"], ["delta", "eps"], ["eps", "x1", "beta", "eps"], ["nowhere", "beta"]):
        found, report = index.search(words, 10)
        assert [(x["doc_id"], x["score"]) for x in found.collect()] == ranked(rows, words, 10)
        x = report.first()
        assert x["scored"] + x["skipped"] == x["blocks"] <= index.blocks
    assert index.search(["nowhere"])[0].count() == index.search([])[0].count() == 0
    index.free()


def test_search_skips_blocks(spark):
    """A few documents hold a rare word many times: other blocks can't reach their scores."""
    rows = [(k, "common " + ("rare " * 9 if k < 30 else "rare " if k % 50 == 0 else "") + "filler " * (k % 20 + (0 if k < 30 else 30))) for k in range(3000)]
    found, report = textsearch.Index(docs_of(spark, rows), 20).search(["rare", "common"], 5)
    assert [(x["doc_id"], x["score"]) for x in found.collect()] == ranked(rows, ["rare", "common"], 5)
    assert report.first()["skipped"] > 80


def test_search_edges(spark):
    assert textsearch.Index(docs_of(spark, [])).search(["a"])[0].count() == 0
    found = textsearch.Index(docs_of(spark, [(1, "a b"), (1, "a b"), (1, "a"), (None, "a")])).search(["a"])[0]
    assert [x["doc_id"] for x in found.collect()] == [1, 1]


def test_index_takes_one_shuffle(spark):
    """Only texts are dealt, once, however batches lie; before, each posting was shuffled four times."""
    rows = [(k % 50, " ".join(["One", "two"] * (k % 3) + [f"w{k % 7}", "é1_b"])) for k in range(60)] + [(70, None), (71, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("copy"), "text").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        lists = textsearch.lists(own, 4, 5.0)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(block") == 1 and "range" not in plan and "Aggregate" not in plan
        got = {(x["term"], p["doc_id"], p["copy"]) for x in lists.collect() for p in x["postings"]}
        assert all(x["n"] == len(x["postings"]) and x["most"] == max(p["part"] for p in x["postings"]) for x in lists.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    copies = {(x["doc_id"], x["text"]): x["copy"] for x in own.collect()}
    assert got == {(w, i, copies[i, t]) for i, t in rows for w in re.findall("[a-z0-9]+", (t or "").lower())}


OLD = {"a.py": "x = 1", "src/m.py": "def f():\n    pass", "src/deep/er/n.py": "class A: pass", "src/gone.py": "import os", "same/one.py": "1", "same/two.py": "1", "was/dir/f.py": "2", "copy1.py": "c", "copy2.py": "c"}
NEW = {"a.py": "x = 1", "src/m.py": "def g():\n    pass", "src/deep/er/n.py": "class A: pass", "lib/gone.py": "import os", "same/one.py": "1", "same/two.py": "1", "was/dir": "2", "copy3.py": "c", "new.py": "def n(): pass"}


def files(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content string").withColumn("hash", F.lit("x"))


def test_diff(spark):
    old, new = (versions.Version(versions.tree(files(spark, d))) for d in (OLD, NEW))
    got = {(r["path"], r["change"], r["before"]) for r in versions.diff(old, new).collect()}
    assert got == {
        ("src/m.py", "changed", None), ("lib/gone.py", "moved", "src/gone.py"), ("was/dir", "moved", "was/dir/f.py"),
        ("copy3.py", "moved", "copy1.py"), ("copy2.py", "removed", None), ("new.py", "added", None),
    }
    assert versions.diff(old, old).count() == 0
    empty = versions.Version(versions.tree(files(spark, OLD).limit(0)))
    assert {r["change"] for r in versions.diff(empty, new).collect()} == {"added"} and versions.diff(empty, empty).count() == 0
    assert versions.diff(new, empty).count() == len(NEW)


def test_diff_reads_changed_folders_only(spark, monkeypatch):
    """One changed file among 3,000 in 100 folders: children of its folders are read, no others."""
    d = {f"top{k % 10}/sub{k % 100}/f{k}.py": str(k) for k in range(3000)}
    old, new = (versions.Version(versions.tree(files(spark, x))) for x in (d, d | {"top7/sub57/f57.py": "changed"}))
    read, real = [], versions.Version.children

    def counted(self, folders, depth):
        out = real(self, folders, depth)
        read.append(out.count())
        return out

    monkeypatch.setattr(versions.Version, "children", counted)
    assert [tuple(r) for r in versions.diff(old, new).collect()] == [("top7/sub57/f57.py", "changed", None)]
    assert sum(read) == 2 * (10 + 10 + 30)


def test_tree_by_hand(spark):
    nodes = {r["path"]: r for r in versions.tree(files(spark, {"/a//b.py": "1", "a/c/d.py": None, "": "x"} | {"e.py": "1"})).collect()}
    assert set(nodes) == {"", "a", "a/c", "a/b.py", "a/c/d.py", "e.py"} and nodes["a/b.py"]["hash"] == nodes["e.py"]["hash"]
    assert (nodes["a/c/d.py"]["parent"], nodes["a/c"]["parent"], nodes["a"]["parent"], nodes[""]["parent"], nodes["a"]["depth"]) == ("a/c", "a", "", None, 1)


def test_reindex(spark, monkeypatch):
    """Entities of the new version as if all files were parsed; only what changed is."""
    old, new = (versions.Version(versions.tree(files(spark, d))) for d in (OLD, NEW))
    known = entities.extract(files(spark, OLD)).cache()
    changes = versions.diff(old, new).cache()
    parsed, real = [], entities.extract

    def counted(df, *a, **b):
        parsed.append(df.count())
        return real(df, *a, **b)

    monkeypatch.setattr(entities, "extract", counted)
    got = versions.reindexed(known, changes, files(spark, NEW))
    assert parsed == [5]
    key = lambda df: sorted((r["path"], r["ord"], r["type"], r["name"]) for r in df.collect())
    assert key(got) == key(real(files(spark, NEW)))
