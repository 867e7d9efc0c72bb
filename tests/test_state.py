"""The state's fold over all kinds of events, in batch and as a keyed stream with timers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import health, state
from codeloom.streaming import state as streams

NAMES = "component.registered component.unregistered component.heartbeat component.error system.shutdown system.metric_updated project.analysis_started project.analysis_completed project.analysis_failed".split()
SCHEMA = "event_id long, ts timestamp, event_type string, name string, status string, response_ms double, details map<string,string>, error string, critical boolean, metric string, value double, files double, entities double"
START = datetime.datetime(2024, 1, 1)


def test_names():
    assert list(state.STATE_EVENTS) == NAMES
    assert len(set(state.METRICS)) == 17 and len(set(state.STATUSES)) == 6


def some_events(n=500, seed=13, gap=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice([*NAMES[:4] * 3, *[NAMES[0], *NAMES[2:4]] * 3, *NAMES[5:], "user.click"])
        kind = "system.shutdown" if i == n - 60 else kind
        name = r.choice(["a", "b", "c", "indexer", None]) if kind.startswith("component") else None
        details = r.choice([None, {"x": str(i)}, {"x": str(i), "y": "1"}])
        status = r.choice(["healthy", "degraded", "unhealthy", "no such", None]) if kind == "component.heartbeat" else None
        rows.append((
            i, START + datetime.timedelta(seconds=gap * (i // 2)), kind, name, status, r.choice([None, 1.5, float(i)]), details, r.choice([None, f"e{i}"]), r.choice([True, False, None]),
            r.choice(["total_errors", "files_processed", "no_such_metric", None]), r.choice([None, float(r.randint(0, 99))]), r.choice([None, 3.0]), 2.0,
        ))
    return rows


def folded(rows):
    """One event after the other."""
    here, counts = {}, dict.fromkeys(state.METRICS, 0.0)
    for _, ts, kind, name, status, response, details, error, critical, metric, value, files, entities in rows:
        own = here.get(name)
        if kind == "component.registered" and name:
            if own:
                own["last_active"] = ts
            else:
                here[name] = {"status": "starting", "error_count": 0, "response_ms": None, "warning": None, "details": {}, "last_active": ts}
        elif kind == "component.unregistered":
            here.pop(name, None)
        elif kind == "component.heartbeat" and own:
            own["last_active"] = ts
            if status in state.STATUSES:
                own["status"] = status
                own["error_count"] = own["error_count"] + 1 if status == "unhealthy" else 0 if status == "healthy" else own["error_count"]
                own["response_ms"] = response if response is not None else own["response_ms"]
                own["details"].update(details or {})
        elif kind == "component.error":
            if own:
                own.update(status="unhealthy", error_count=own["error_count"] + 1, warning=error or "Unknown error", last_active=ts)
                own["details"]["last_error"] = error or "Unknown error"
        elif kind == "system.shutdown":
            for x in here.values():
                x["status"] = "stopped"
        elif kind == "project.analysis_started" and "indexer" in here:
            here["indexer"]["last_active"] = ts
        elif kind == "system.metric_updated" and metric in counts and value is not None:
            counts[metric] = value
        if kind in ("component.error", "project.analysis_failed"):
            counts["total_errors"] += 1
            counts["critical_errors"] += bool(kind == "component.error" and critical)
        if kind == "project.analysis_completed":
            counts["projects_analyzed"] += 1
            counts["files_processed"] += files or 0
            counts["entities_extracted"] += entities
    return here, counts


def states(df):
    return {x["name"]: {k: x[k] for k in ("status", "error_count", "response_ms", "warning", "details", "last_active")} for x in df.collect()}


@pytest.mark.parametrize("seed", [13, 14, 15])
@pytest.mark.parametrize("few", [100_000, 0])
def test_batch(spark, seed, few, monkeypatch):
    monkeypatch.setattr(state, "BROADCAST_ROWS", few)
    rows = some_events(seed=seed)
    here, counts = folded(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("said", F.lit("x")).withColumn("born", F.lit(1))
    assert states(state.components(df)) == here and len(here) > 1
    assert {x["name"]: x["value"] for x in state.counters(df).collect()} == counts


def test_batch_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert state.components(none).count() == 0 and {x["value"] for x in state.counters(none).collect()} == {0.0}
    blank = spark.createDataFrame([(1, None, "component.registered", "a", *[None] * 9), (2, START, None, "b", *[None] * 9), (3, START, "component.registered", None, *[None] * 9)], SCHEMA)
    assert state.components(blank).count() == 0


def streamed(spark, rows, folder, batches, late="1 second"):
    """What the stream has written after ``rows`` in so many micro-batches, one file each."""
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = streams.states(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), late).writeStream.foreachBatch(
            lambda df, n: df.withColumn("epoch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
        ).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()  # each run goes on from the checkpoint
        q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(f"{folder}/out").drop("epoch")


def test_stream_equals_batch(spark, tmp_path):
    rows = some_events(n=240, seed=21)
    out = streamed(spark, rows, tmp_path, 3)
    here, counts = folded(rows)
    assert states(streams.components(out)) == here
    found = {x["name"]: x["value"] for x in streams.counters(out).collect()}
    assert found == {k: v for k, v in counts.items() if k in found} and {k for k, v in counts.items() if v} <= set(found)


def test_silent_component_is_told_by_its_timer(spark, tmp_path):
    none = [None] * 9
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(1, at(0), "component.registered", "quiet", *none), (2, at(1), "component.registered", "loud", *none), (3, at(2), "component.registered", "gone", *none)]
    rows += [(4, at(3), "component.unregistered", "gone", *none), (5, at(290), "component.heartbeat", "loud", "healthy", *none[1:]), (6, at(295), "user.click", None, *none)]
    rows += [(7, at(400), "component.heartbeat", "loud", "healthy", *none[1:]), (8, at(401), "component.heartbeat", "loud", "healthy", *none[1:]), (9, at(402), "component.heartbeat", "loud", "healthy", *none[1:])]
    out = streamed(spark, rows, tmp_path, 3)
    assert {x["name"] for x in out.filter("silent").collect()} == {"quiet"}
    assert {x["name"]: x["silent"] for x in streams.latest(out).filter("present").collect()} == {"quiet": True, "loud": False}
    # The same as the batch report of silent components as of the last event.
    df = spark.createDataFrame(rows, SCHEMA)
    alive = state.components(df).select("name", F.col("last_active").alias("ts"))
    assert [x["name"] for x in health.stale(alive, df.agg(F.max("ts").alias("as_of"))).collect()] == ["quiet"]
