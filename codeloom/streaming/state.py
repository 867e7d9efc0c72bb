"""The system's state kept by a stream: one keyed state for each component and metric, timers for silent components.

Events of all kinds in :data:`codeloom.operators.state.STATE_EVENTS` become changes of a component, of a metric or of the whole system, and
each key's changes of a micro-batch are folded at once, column by column, in order of (ts, event_id). Details are a
map state, written key by key. A component that is silent for ``SILENT_MS`` of event time is reported by a
timer of its own, once. A shutdown concerns all keys, so it is a row of its own that :func:`current` applies.

Order holds within a micro-batch, and between them where events arrive in order. The state store is Spark's RocksDB
provider (:func:`codeloom.session.session` sets it); a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

from codeloom.operators import state as s

SILENT_MS = 300_000
SYSTEM = "system"
_KINDS = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType(), "map": MapType(StringType(), StringType())}


def _schema(fields: str) -> StructType:
    """``name kind`` pairs as a schema; workers have no session that could parse one."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


OUTPUT = _schema(
    "kind string, name string, present boolean, status string, said_ts timestamp, said_id long, error_count long, response_ms double, warning string, "
    "details map, last_active timestamp, value double, silent boolean, seen long"
)
CORE = _schema("present boolean, status string, said_ts long, said_id long, error_count long, response_ms double, warning string, last_active long, value double, is_set boolean, seen long, silent boolean")
EMPTY = (False, None, None, None, 0, None, None, None, 0.0, False, 0, False)


def changes(events: DataFrame) -> DataFrame:
    """The changes that events make, by the key (kind, name) that they concern."""
    none = lambda kind: F.lit(None).cast(kind)
    failed = F.col("event_type") == s.ERROR
    error = F.coalesce("error", F.lit("Unknown error"))
    told = F.when(failed, F.create_map(F.lit("last_error"), error)).when(s.said().isNotNull(), F.col("details"))
    parts = s.named(events).select(
        F.lit("component").alias("kind"), "name", "ts", "event_id", "event_type", s.said().alias("said"), F.when(s.said().isNotNull() & ~failed, F.col("response_ms")).alias("response_ms"),
        told.alias("details"), F.when(failed, error).alias("warning"), none("string").alias("op"), none("double").alias("amount"),
    )
    rest = [none("string"), none("double"), none("map<string,string>"), none("string")]
    metrics = s.changes(events).select(F.lit("metric"), "name", "ts", "event_id", F.lit(s.METRIC), *rest, "op", "amount")
    down = events.filter(F.col("event_type") == s.SHUTDOWN).select(F.lit(SYSTEM), F.lit(SYSTEM), "ts", "event_id", "event_type", *rest, none("string"), none("double"))
    return parts.union(metrics).union(down)


class Keeper(StatefulProcessor):
    """Folds the changes of one key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", CORE)
        self.details = handle.getMapState("details", _schema("key string"), _schema("value string"))

    def _row(self, key: tuple, core: dict) -> pd.DataFrame:
        at = lambda us: pd.Timestamp(us, unit="us") if us is not None else pd.NaT
        details = {k[0]: v[0] for k, v in self.details.iterator()} if self.details.exists() else {}
        own = {k: core[k] for k in ("present", "status", "said_id", "error_count", "response_ms", "warning", "value", "silent", "seen")}
        own |= {"kind": key[0], "name": key[1], "said_ts": at(core["said_ts"]), "last_active": at(core["last_active"]), "details": details}
        frame = pd.DataFrame([own])[OUTPUT.names]
        return frame.astype({"said_id": "Int64", "error_count": "int64", "seen": "int64", "response_ms": "float64", "value": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = CORE.names
        core = dict(zip(names, self.core.get() if self.core.exists() else EMPTY))
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        core["seen"] += len(batch)
        if key[0] == "metric":
            self._metric(core, batch)
        elif key[0] == SYSTEM:
            self._said(core, batch.iloc[-1:], "stopped")
        else:
            self._component(core, batch)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if core["present"]:
                core["silent"] = False
                self.handle.registerTimer(core["last_active"] // 1000 + SILENT_MS)
        self.core.update(tuple(core[n] for n in names))
        yield self._row(key, core)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = CORE.names
        core = dict(zip(names, self.core.get()))
        core["silent"] = True
        core["seen"] += 1
        self.core.update(tuple(core[n] for n in names))
        yield self._row(key, core)

    def close(self) -> None:
        pass

    @staticmethod
    def _us(t) -> int:
        return int(pd.Timestamp(t).value // 1000)

    def _said(self, core: dict, row: pd.DataFrame, status: str) -> None:
        core.update(status=status, said_ts=self._us(row["ts"].iloc[0]), said_id=int(row["event_id"].iloc[0]))

    @staticmethod
    def _metric(core: dict, batch: pd.DataFrame) -> None:
        batch = batch[batch["amount"].notna()].reset_index(drop=True)
        sets = batch.index[batch["op"] == "set"]
        if len(sets):
            core.update(value=float(batch["amount"][sets[-1]]), is_set=True)
            batch = batch.loc[sets[-1] + 1 :]
        core["value"] += float(batch["amount"].sum())

    def _component(self, core: dict, batch: pd.DataFrame) -> None:
        batch = batch.reset_index(drop=True)
        gone = batch.index[batch["event_type"] == s.UNREGISTERED]
        if len(gone):
            self.details.clear()
            core.update(zip(("present", "status", "said_ts", "said_id", "error_count", "response_ms", "warning", "last_active"), EMPTY))
            batch = batch.loc[gone[-1] + 1 :]
        if not core["present"]:
            born = batch.index[batch["event_type"] == s.REGISTERED]
            if not len(born):
                return
            batch = batch.loc[born[0] :]
            core["present"] = True
            self._said(core, batch.iloc[:1], "starting")
        if not len(batch):
            return
        core["last_active"] = max(core["last_active"] or 0, self._us(batch["ts"].iloc[-1]))
        heard = batch[batch["said"].notna()]
        if len(heard):
            self._said(core, heard.iloc[-1:], heard["said"].iloc[-1])
            healthy = heard.index[heard["said"] == "healthy"]
            core["error_count"] = (0 if len(healthy) else core["error_count"]) + int((heard.loc[healthy[-1] if len(healthy) else heard.index[0] :, "said"] == "unhealthy").sum())
            for column in ("response_ms", "warning"):
                given = heard[column].dropna()
                if len(given):
                    core[column] = given.iloc[-1]
            merged: dict = {}
            for d in heard["details"].dropna():
                merged.update(dict(d))
            for k, v in merged.items():
                self.details.updateValue((k,), (v,))


def states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of each key's state after each micro-batch that changes it, and of timers that expire (``silent``)."""
    rows = changes(events).withWatermark("ts", late)
    return rows.groupBy("kind", "name").transformWithStateInPandas(Keeper(), OUTPUT, "Update", "EventTime")


def latest(out: DataFrame) -> DataFrame:
    """The last row of each key among the rows that :func:`states` has written so far."""
    return out.groupBy("kind", "name").agg(F.max_by(F.struct(*[F.col(c) for c in out.columns if c not in ("kind", "name")]), "seen").alias("x")).select("kind", "name", "x.*")


def components(out: DataFrame) -> DataFrame:
    """The rows of :func:`codeloom.operators.state.components`, from what the stream has written."""
    rows = latest(out)
    down = rows.filter(F.col("kind") == SYSTEM).agg(F.max(F.struct("said_ts", "said_id")).alias("down"))
    own = rows.filter("kind = 'component' and present").crossJoin(F.broadcast(down))  # one row
    status = F.when(F.col("down") > F.struct("said_ts", "said_id"), "stopped").otherwise(F.col("status"))
    return own.select("name", status.alias("status"), "error_count", "response_ms", "warning", "details", "last_active")


def counters(out: DataFrame) -> DataFrame:
    """(name, value) of the metrics that have changed."""
    return latest(out).filter("kind = 'metric'").select("name", "value")
