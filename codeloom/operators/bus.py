"""Publish and subscribe as joins: who gets which event, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.runtime.errors import EventBusError
from codeloom.runtime.scratch import cut, small

#: Subscriptions beyond this many are joined by shuffle.
BROADCAST_ROWS = 10_000
SALTS = 32


def accepted() -> Column:
    """The subscription's filter; a filter that fails or is null on an event rejects it."""
    return F.col("min_value").isNull() | F.coalesce(F.col("value") > F.col("min_value"), F.lit(False))


def dispatch(events: DataFrame, subs: DataFrame) -> DataFrame:
    """(event, subscription) deliveries: equal types by an equi-join, wildcards by a salted key.

    A condition ``type = or *`` would be a nested loop over all events; the split never is.
    """
    right = subs.withColumnRenamed("event_type", "sub_type")
    typed = events.join(small(right.filter("sub_type <> '*'"), BROADCAST_ROWS), F.col("event_type") == F.col("sub_type"))
    # Each event meets each wildcard. Beyond a broadcast, events are dealt over SALTS keys, and each key has all wildcards.
    salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS))
    salts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))
    any_ = right.filter("sub_type = '*'").withColumn("any", salts)
    wild = events.withColumn("salt", salt).join(small(any_, SALTS * BROADCAST_ROWS // 10), F.col("any") == F.col("salt")).drop("any", "salt")
    return typed.unionByName(wild).filter(accepted()).withColumn("is_wildcard", F.col("sub_type") == "*")


def delivery_order(deliveries: DataFrame) -> DataFrame:
    """``position`` of each delivery: higher priority first, typed before wildcard, then subscription order."""
    w = Window.partitionBy("event_id").orderBy(F.desc("priority"), "is_wildcard", "seq")
    return deliveries.withColumn("position", F.row_number().over(w))


def fifo(events: DataFrame) -> DataFrame:
    """One queue in order of time: ranks within a day, and the events of the days before, so no task sorts all."""
    dated = events.withColumn("day", F.to_date("ts"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each day.
    days = dated.groupBy("day").agg(F.count("*").alias("n")).select(F.col("day").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    ranked = dated.withColumn("position", F.row_number().over(w)).join(small(days, BROADCAST_ROWS), F.col("day").eqNullSafe(F.col("of")))
    return ranked.withColumn("position", F.col("position") + F.col("before")).drop("of", "before")


def subscribe(requests: DataFrame) -> DataFrame:
    """A row for each type of a subscription; ``*`` within a list is a plain type."""
    return requests.select("sub_id", F.explode("event_types").alias("event_type"), "priority")


def unsubscribe(subs: DataFrame, gone: DataFrame) -> DataFrame:
    return subs.join(gone, "sub_id", "left_anti")


def unsubscribe_all(subs: DataFrame, event_type: str | None = None) -> DataFrame:
    """What is left: nothing without a type; else all but the rows of that type, ``*`` for the wildcards."""
    return subs.limit(0) if event_type is None else subs.filter(F.col("event_type") != event_type)


def type_list(requests: DataFrame) -> DataFrame:
    """A subscription's types as one text, in the order given."""
    return requests.select("sub_id", F.array_join("event_types", ",").alias("event_type"))


def with_defaults(events: DataFrame) -> DataFrame:
    """A correlation id where none or an empty one is given, normal priority where none is."""
    own = F.coalesce(F.nullif(F.col("correlation_id"), F.lit("")), F.sha2(F.col("event_id").cast("string"), 256))
    return events.withColumn("correlation_id", own).withColumn("priority", F.coalesce("priority", F.lit(50)))


def through(events: DataFrame, *middleware, errors: list | None = None) -> DataFrame:
    """Each middleware maps events to events, in order; one that fails, or gives no table, is noted and left out.

    It fails where the plan can't be made or analysed. With ``errors`` it is run for its own result as well, so that
    failures of rows count too.
    """
    for f in middleware:
        try:
            new = f(events)
            if not isinstance(new, DataFrame):
                raise EventBusError("a middleware must return events", middleware=getattr(f, "__name__", str(f)))
            new.schema
            events = cut(new) if errors is not None else new
        except Exception as e:  # noqa: BLE001  the old events go on
            if errors is not None:
                errors.append(e)
    return events
