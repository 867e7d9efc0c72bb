"""Structured Streaming forms of the bus and of component state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators import bus


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Events of a folder as a stream; the rate limit stands for a bounded queue and drops nothing."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


Handler = Callable[[DataFrame, int], None]


def deliver(
    events: DataFrame,
    subs: DataFrame,
    handler: Handler,
    checkpoint: str,
    errors: list | None = None,
    name: str | None = None,
    pre: tuple[Callable[[DataFrame], DataFrame], ...] = (),
    post: tuple[Handler, ...] = (),
    on_error: tuple[Callable[[Exception, int], None], ...] = (),
) -> StreamingQuery:
    """Dispatch each micro-batch in delivery order, by the query ``name``.

    ``pre`` maps the events before they are dispatched (one that fails is left out), ``post`` sees the events after
    the handler. With ``errors`` or ``on_error``, what fails is recorded and told to each error handler, apart
    from the others, and the stream goes on; else a failure of the handler ends it.
    """
    isolated = errors is not None or bool(on_error)

    def told(e: Exception, epoch: int) -> None:
        if errors is not None:
            errors.append((epoch, e))
        for f in on_error:
            try:
                f(e, epoch)
            except Exception as other:  # noqa: BLE001  error handlers don't disturb one another
                if errors is not None:
                    errors.append((epoch, other))

    def batch(df: DataFrame, epoch: int) -> None:
        skipped: list = []
        df = bus.through(df, *pre, errors=skipped)
        for e in skipped:
            told(e, epoch)
        try:
            handler(bus.delivery_order(bus.dispatch(df, subs)).orderBy("ts", "event_id", "position"), epoch)
        except Exception as e:  # noqa: BLE001  handlers are isolated from the stream
            if not isolated:
                raise
            told(e, epoch)
        for f in post:
            try:
                f(df, epoch)
            except Exception as e:  # noqa: BLE001  a side effect doesn't end the stream
                told(e, epoch)

    out = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.queryName(name) if name else out).start()


class Bus:
    """A named bus: one streaming query, started, stopped and started again from its checkpoint."""

    def __init__(self, name: str, start: Callable[[str], StreamingQuery]):
        self.name, self._start, self.query = name, start, None

    def start(self) -> StreamingQuery:
        """The running query; one that has ended, by a failure too, is begun again where its checkpoint stands."""
        if self.query is None or not self.query.isActive:
            self.query = self._start(self.name)
        return self.query

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def run(self, restarts: int = 1) -> StreamingQuery:
        """Until the stream's end; after a fatal error it is begun again, ``restarts`` times at most."""
        for left in range(restarts, -1, -1):
            try:
                self.start().awaitTermination()
                break
            except Exception:
                if not left:
                    raise
        return self.query


_BUSES: dict[str, Bus] = {}


def named_bus(start: Callable[[str], StreamingQuery], name: str = "default") -> Bus:
    """The bus of that name; the first call makes it."""
    return _BUSES.setdefault(name, Bus(name, start))


def error_rate(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of event time; later events than the watermark allows are left out."""
    rate = F.count_if(F.col("event_type") == "error") / F.count("*")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), rate.alias("error_rate"))
    return out.select(F.col("w.start").alias("start"), "n", "error_rate")


STATE = "status string, error_count long, seen long"
OUTPUT = "name string, status string, error_count long, seen long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, errors, seen = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    healthy = (rows["status"] == "healthy").to_numpy().nonzero()[0]
    after = rows["status"].iloc[healthy[-1] :] if len(healthy) else rows["status"]
    errors = (0 if len(healthy) else errors) + int((after == "unhealthy").sum())
    status, seen = rows["status"].iloc[-1], seen + len(rows)
    state.update((status, errors, seen))
    yield pd.DataFrame([{"name": key[0], "status": status, "error_count": errors, "seen": seen}])


def component_state(events: DataFrame) -> DataFrame:
    """Status, error streak and number of reports of each component after each micro-batch."""
    return events.groupBy("name").applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
