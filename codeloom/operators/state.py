"""The system's state as a fold over its events: registered components and counters.

A component is there from its first registration after it was last unregistered; a registration of one that is there
changes nothing but its activity. It starts as ``starting``; heartbeats with a known status and errors change its
status, a shutdown stops what is there. Unknown statuses only count as activity, unknown metrics not at all.

Life cycle events are few, so the spans in which components are registered come from them alone; all other events
then meet their component's span in one pass and are aggregated before they are shuffled. No component's events
are gathered in one task.

Nulls: an event without a name, kind or time is ignored (time: the shutdown too). Empty tables give no components, and counters
at zero. Events at the same time are in order of event_id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import health
from codeloom.runtime.scratch import small

#: Kinds of events that change the state (fixed values).
STATE_EVENTS = (
    "component.registered",
    "component.unregistered",
    "component.heartbeat",
    "component.error",
    "system.shutdown",
    "system.metric_updated",
    "project.analysis_started",
    "project.analysis_completed",
    "project.analysis_failed",
)
REGISTERED, UNREGISTERED, HEARTBEAT, ERROR, SHUTDOWN, METRIC, STARTED, COMPLETED, FAILED = STATE_EVENTS
#: Statuses of a component (fixed values).
STATUSES = ("healthy", "degraded", "unhealthy", "unknown", "starting", "stopped")
#: Counters and gauges that events may set (fixed values).
METRICS = (
    "uptime_seconds",
    "projects_analyzed",
    "files_processed",
    "entities_extracted",
    "graph_nodes",
    "graph_relationships",
    "embeddings_generated",
    "agent_tasks_completed",
    "total_errors",
    "error_rate_5min",
    "critical_errors",
    "memory_usage_mb",
    "cpu_percent",
    "disk_usage_percent",
    "avg_indexing_time_ms",
    "avg_query_time_ms",
    "avg_embedding_time_ms",
)
#: The component that the start of an analysis makes active (fixed value).
INDEXER = "indexer"
BROADCAST_ROWS = 100_000


def at() -> Column:
    """An event's place in the order."""
    return F.struct("ts", "event_id")


def said() -> Column:
    """The status that an event gives its component, else null."""
    known = (F.col("event_type") == HEARTBEAT) & F.col("status").isin(*STATUSES)
    return F.when(F.col("event_type") == ERROR, "unhealthy").when(known, F.col("status"))


def named(events: DataFrame) -> DataFrame:
    """The events that concern a component, under its name."""
    name = F.when(F.col("event_type") == STARTED, INDEXER).when(F.col("event_type").startswith("component."), F.col("name"))
    return events.withColumn("name", name).filter(F.col("name").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isin(REGISTERED, UNREGISTERED, HEARTBEAT, ERROR, STARTED))


def components(events: DataFrame) -> DataFrame:
    """name, status, error_count, response_ms, warning, details, last_active of the components that are there in the end.

    ``events``: event_id, ts, event_type, name, status, response_ms, details (map of strings), error.
    """
    own = named(events).select("event_id", "ts", "event_type", "name", said().alias("said"), "response_ms", "details", "error")
    cycle = own.filter(F.col("event_type").isin(REGISTERED, UNREGISTERED)).select("name", "event_type", at().alias("at"))
    gone = cycle.groupBy("name").agg(F.max(F.when(F.col("event_type") == UNREGISTERED, F.col("at"))).alias("gone"))
    here = cycle.filter(F.col("event_type") == REGISTERED).join(small(gone, BROADCAST_ROWS), "name").filter("gone is null or at > gone")
    born = small(here.groupBy("name").agg(F.min("at").alias("born")), BROADCAST_ROWS)
    since = own.join(born, "name").filter(at() >= F.col("born"))
    healed = since.filter("said = 'healthy'").groupBy("name").agg(F.max(at()).alias("healed"))
    since = since.join(small(healed, BROADCAST_ROWS), "name", "left")
    heard = F.col("said").isNotNull()

    def last(column: Column, when: Column) -> Column:
        return F.max_by(column, F.when(when, at()))

    failed = F.col("event_type") == ERROR  # an error has no response time
    state = since.groupBy("name").agg(
        F.coalesce(last(F.col("said"), heard), F.lit("starting")).alias("status"),
        F.coalesce(F.max(F.when(heard, at())), F.min("born")).alias("said_at"),
        F.count_if((F.col("said") == "unhealthy") & (F.col("healed").isNull() | (at() > F.col("healed")))).alias("error_count"),
        last(F.col("response_ms"), heard & ~failed & F.col("response_ms").isNotNull()).alias("response_ms"),
        last(F.coalesce("error", F.lit("Unknown error")), failed).alias("warning"),
        F.max("ts").alias("last_active"),
    )
    told = F.when(failed, F.create_map(F.lit("last_error"), F.coalesce("error", F.lit("Unknown error")))).when(heard, F.col("details"))
    pairs = since.select("name", "ts", "event_id", F.explode(told).alias("key", "value")).groupBy("name", "key").agg(F.max_by("value", at()).alias("value"))
    merged = pairs.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("details"))
    return _stopped(state.join(merged, "name", "left"), events)


def _stopped(state: DataFrame, events: DataFrame) -> DataFrame:
    """``state`` with the last shutdown applied to what hasn't been heard of since."""
    down = events.filter(F.col("event_type") == SHUTDOWN).filter("ts is not null").agg(F.max(at()).alias("down"))
    out = state.crossJoin(F.broadcast(down))  # one row
    status = F.when(F.col("down") > F.col("said_at"), "stopped").otherwise(F.col("status"))
    none = F.create_map().cast("map<string,string>")
    return out.select("name", status.alias("status"), "error_count", "response_ms", "warning", F.coalesce("details", none).alias("details"), "last_active")


def changes(events: DataFrame) -> DataFrame:
    """The changes (name, op, amount, ts, event_id) of counters that events make."""
    kind = F.col("event_type")

    def change(when: Column, name: str, amount: Column, op: str = "add") -> Column:
        return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(op).alias("op"), amount.cast("double").alias("amount")))

    asked = F.struct(F.col("metric").alias("name"), F.lit("set").alias("op"), F.col("value").cast("double").alias("amount"))
    made = F.array(
        change(kind.isin(ERROR, FAILED), "total_errors", F.lit(1)),
        change((kind == ERROR) & F.coalesce("critical", F.lit(False)), "critical_errors", F.lit(1)),
        change(kind == COMPLETED, "projects_analyzed", F.lit(1)),
        change((kind == COMPLETED) & F.col("files").isNotNull(), "files_processed", F.col("files")),
        change((kind == COMPLETED) & F.col("entities").isNotNull(), "entities_extracted", F.col("entities")),
        F.when((kind == METRIC) & F.col("metric").isin(*METRICS), asked),
    )
    rows = events.filter(kind.isin(ERROR, FAILED, COMPLETED, METRIC)).filter("ts is not null")
    return rows.select("ts", "event_id", F.explode(F.array_compact(made)).alias("c")).select("c.name", "c.op", "c.amount", "ts", "event_id")


def counters(events: DataFrame) -> DataFrame:
    """(name, value) of all metrics after all events; those that no event changed are 0.

    ``events``: event_id, ts, event_type, critical, metric, value, files, entities.
    """
    names = events.sparkSession.createDataFrame([(m,) for m in METRICS], "name string")
    found = health.folded_metric(changes(events))
    return names.join(found, "name", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"))
