"""Forgetting: sums and samples in which old events count less, mergeable over partitions and batches.

An event of age a counts exp(-a ln 2 / ``half_life``). Sums are kept by day, each decayed to the day's end only, so what they hold never
overflows and needs no rewriting as time goes on: states of any parts of the events are merged by adding them up, and reading
decays each day to the moment asked for. A sample keeps the rows of the largest keys; the largest of several samples' rows are
the sample of all.

Nulls: rows without a time are ignored, rows without a value count with weight but no value. Events after the moment that is
asked for are left out by whole days at most: a state is read as of its last day's end or later. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def state(events: DataFrame, half_life: float, *by: str) -> DataFrame:
    """(by..., day, n, weight, total) of ``events`` (by..., ts, value); days are counted from 1970."""
    rate = 0.6931471805599453 / half_life
    day = F.floor(_seconds(F.col("ts")) / DAY)
    weight = F.exp(-rate * ((day + 1) * DAY - _seconds(F.col("ts"))))
    rows = events.filter("ts is not null").select(*by, day.alias("day"), weight.alias("w"), F.col("value").cast("double").alias("v"))
    return rows.groupBy(*by, "day").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0)).alias("total"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state of several, united."""
    return states.groupBy(*by, "day").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def read(states: DataFrame, half_life: float, as_of_day: int | Column, *by: str) -> DataFrame:
    """(by..., n, weight, total) of a state as of the end of a day, later days left out."""
    rate = 0.6931471805599453 / half_life
    last = F.lit(as_of_day) if isinstance(as_of_day, int) else as_of_day
    fade = F.exp(-rate * DAY * (last - F.col("day")))
    return states.filter(F.col("day") <= last).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("weight") * fade).alias("weight"), F.sum(F.col("total") * fade).alias("total"))


def sample(events: DataFrame, half_life: float, k: int, ident: str = "event_id") -> DataFrame:
    """``k`` rows drawn without replacement, younger ones likelier, with their ``key``; the draw depends on ids and times alone.

    Each row has the key t ln 2 / half_life - ln(-ln u), u being uniform by a hash of its id: the largest keys are a sample
    weighted by exp(t ln 2 / half_life).
    """
    u = (F.pmod(F.col(ident) * F.lit(2_654_435_761), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    key = _seconds(F.col("ts")) * (0.6931471805599453 / half_life) - F.log(-F.log(u))
    return top(events.filter("ts is not null").withColumn("key", key), k, ident)


def top(rows: DataFrame, k: int, ident: str = "event_id") -> DataFrame:
    """The sample of several samples, united."""
    return rows.orderBy(F.desc("key"), ident).limit(k)
