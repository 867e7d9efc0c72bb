"""Reuse distances against LRU lists, one access after the other."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import reuse

START = datetime.datetime(2024, 1, 1)


def by_hand(rows):
    """The place of each key in its log's list of recent keys."""
    recent, out = {}, []
    for log, _, i, key in sorted(rows, key=lambda r: (r[1], r[2])):
        own = recent.setdefault(log, [])
        out.append((log, i, own.index(key) if key in own else None))
        if key in own:
            own.remove(key)
        own.insert(0, key)
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("grid", [512, 7, 1])
def test_distances(spark, grid, monkeypatch):
    monkeypatch.setattr(reuse, "GRID", grid)
    r = random.Random(3)
    rows = [(r.choice("aaab"), START + datetime.timedelta(hours=r.randrange(120)), i, r.choice("pqrstuvwxyz") if r.random() < 0.9 else f"k{i}") for i in range(600)]
    bad = [(None, START, 900, "p"), ("a", None, 901, "p"), ("a", START, 902, None)]
    df = spark.createDataFrame([*rows, *bad], "log string, ts timestamp, event_id long, key string").withColumn("day", F.lit("x")).withColumn("position", F.lit(1)).repartition(5)
    found = reuse.distances(df)
    assert sorted(((x["log"], x["event_id"], x["distance"]) for x in found.collect()), key=lambda x: x[1]) == by_hand(rows)
    tier = {x["event_id"]: x["tier"] for x in reuse.tiers(found, 3, 4).collect()}
    assert tier == {i: 3 if n is None or n >= 7 else 2 if n >= 3 else 1 for _, i, n in by_hand(rows)}
    assert reuse.distances(df.limit(0)).count() == 0


@pytest.mark.parametrize(("grid", "stretch"), [(512, 1), (7, 1), (1, 1), (7, 20), (512, 1000)])
def test_stretches(spark, grid, stretch, monkeypatch):
    """Many logs in one task, wide ones among them, in batches smaller than a stretch."""
    monkeypatch.setattr(reuse, "GRID", grid)
    monkeypatch.setattr(reuse, "STRETCH", stretch)
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", f"l{r.randrange(60)}"]), START + datetime.timedelta(hours=r.randrange(120)), i, r.choice("pqrstuvwxyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "log string, ts timestamp, event_id long, key string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(((x["log"], x["event_id"], x["distance"]) for x in reuse.distances(df).collect()), key=lambda x: x[1]) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_logs_are_no_groups_of_their_own(spark):
    """Before, each access of a short log was a group, and each log a grid."""
    rows = [(f"l{k % 50}", START + datetime.timedelta(hours=k), k, "pqr"[k % 3]) for k in range(400)]
    found = reuse.distances(spark.createDataFrame(rows, "log string, ts timestamp, event_id long, key string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1 and found.count() == 400


def test_greater_before():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        v = r.integers(-20, 20, n)
        assert reuse.greater_before(v).tolist() == [int((v[:k] > v[k]).sum()) for k in range(n)]
