"""Reuse distances of an access log: in which tier of a memory hierarchy with LRU each access is found, for any sizes at once.

The distance of an access is the number of other keys that its log has seen since the key's access before: with LRU, a tier of c
entries holds it if the distance is below c. It is the number of accesses between, less those that repeat a key seen
between, that is less the accesses k before i whose own previous access is after p, i's previous one.

Those are counted over a grid: each log's positions fall into at most ``GRID`` equal stretches of ``STRETCH`` or more, and so do the previous
positions. Cells that are before in one way and after in the other count as wholes (at most ``GRID`` squared numbers a log); what
lies in the same stretch of positions, or of previous positions, is counted there, by order statistics. So no
task holds more than a ``GRID``-th of a log, or ``STRETCH`` of it, and positions come from ranks within a day and counts of days. Logs of
at most ``STRETCH`` accesses are one stretch, have no cells, and are counted many at once as they stream by.

Nulls: rows without a log, key or time are left out. Ties of time are in order of event_id. A first access has no distance and is found in the last
tier. Repeated event ids are accesses of their own where times differ, else in any order. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.runtime.scratch import cut, small

GRID, STRETCH = 512, 65_536
BROADCAST_ROWS = 100_000


def greater_before(values: np.ndarray) -> np.ndarray:
    """Of each element, how many before it are greater: bit by bit from the highest, within elements of equal higher bits."""
    _, rank = np.unique(values, return_inverse=True)
    order, out = np.arange(len(values)), np.zeros(len(values), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        own = rank[order]
        one, group = (own >> bit) & 1, own >> (bit + 1)
        before = np.cumsum(one) - one
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before -= np.repeat(before[starts], np.diff(np.r_[starts, len(group)]))
        out[order[one == 0]] += before[one == 0]
        order = order[np.argsort(own >> bit, kind="stable")]
    return out


def _begins(b: pa.RecordBatch) -> np.ndarray:
    """Whether a row is of another (log, stretch) than the one before; the first is."""
    out = np.ones(b.num_rows, bool)
    out[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]], axis=0)
    return out


def _more(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    b = pa.concat_batches(batches)
    values = b.column(3).to_numpy()
    values = values - values.min()
    # Of later stretches all values are higher, so none of them is below one of a stretch before.
    more = greater_before(np.cumsum(_begins(b)) * (values.max() + 1) + values)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(more)], ["log", "position", "more"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (log, stretch, position, value), sorted by log, stretch: how many before in the stretch have a greater value.

    All whole stretches of a batch are counted together; the rows of its last one wait for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in (0, 1)):
            yield _more(held)
            held = []
        cuts = np.flatnonzero(_begins(b)[1:]) + 1
        if len(cuts):
            yield _more([*held, b.slice(0, cuts[-1])])
            held = []
        held.append(b.slice(cuts[-1] if len(cuts) else 0))
    if held:
        yield _more(held)


def _counted(rows: DataFrame, stretch: str, order: Column, value: Column) -> DataFrame:
    """(log, position, more): in one ``stretch``, how many of the accesses before in this order have a greater value."""
    sorted_ = rows.repartition("log", stretch).sortWithinPartitions("log", stretch, order)
    return sorted_.select("log", stretch, "position", value.alias("value")).mapInArrow(_within, "log string, position long, more long")


def _cells(t: pa.Table) -> pa.Table:
    """Of each cell (at, of) of a log: the accesses in cells before it in ``at`` and after it in ``of``."""
    at, of, n = (t[c].to_numpy() for c in ("at", "of", "n"))
    grid = np.zeros((GRID + 1, GRID + 1), np.int64)
    np.add.at(grid, (at + 1, of), n)
    grid = np.cumsum(np.cumsum(grid[:, ::-1], axis=1)[:, ::-1], axis=0)
    return pa.table({"log": t["log"], "at": t["at"], "of": t["of"], "wholes": grid[at, of + 1]})


def distances(accesses: DataFrame) -> DataFrame:
    """(log, event_id, distance) of ``accesses`` (log, ts, event_id, key); first accesses have no distance."""
    own = accesses.select(F.col("log").cast("string").alias("log"), "ts", "event_id", F.col("key").cast("string").alias("key")).dropna(subset=["log", "ts", "key"])
    own = own.withColumn("day", F.to_date("ts"))
    # Positions: counts of the days before, and the rank within the day.
    days = own.groupBy("log", "day").agg(F.count("*").alias("n"))
    before = Window.partitionBy("log").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("log", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("log")).alias("size"))
    rank = F.row_number().over(Window.partitionBy("log", "day").orderBy("ts", "event_id"))
    rows = own.withColumn("r", rank).join(days, ["log", "day"]).select("log", "key", "day", "event_id", (F.col("offset") + F.col("r") - 1).alias("position"), "size")
    # The previous access of a key: within the day, or the last one of the key's day before.
    last = rows.groupBy("log", "key", "day").agg(F.max("position").alias("last"))
    last = last.select("log", "key", "day", F.lag("last").over(Window.partitionBy("log", "key").orderBy("day")).alias("earlier"))
    mine = F.lag("position").over(Window.partitionBy("log", "key", "day").orderBy("position"))
    rows = cut(rows.withColumn("mine", mine).join(last, ["log", "key", "day"]).select("log", "event_id", "position", F.coalesce("mine", "earlier").alias("previous"), "size"))
    width = F.greatest(F.ceil(F.col("size") / GRID), F.lit(STRETCH))
    stretch: dict[str, Column] = {n: F.floor(F.col(c) / width).cast("long").alias(n) for n, c in (("at", "position"), ("of", "previous"))}
    again = rows.filter("previous is not null").select("log", "position", "previous", *stretch.values(), (F.col("size") > width).alias("wide"))
    # Accesses before in the same stretch with a later previous position; of those in other stretches, see _cells and the last line.
    parts = _counted(again, "at", F.col("position"), F.col("previous"))
    wide = cut(again.filter("wide").drop("wide"))
    if not wide.isEmpty():
        cells = wide.groupBy("log", "at", "of").agg(F.count("*").alias("n"))
        wholes = small(cut(cells.groupBy("log").applyInArrow(_cells, "log string, at long, of long, wholes long")), BROADCAST_ROWS)
        parts = parts.union(_counted(wide, "of", F.desc("previous"), -F.col("at")))
        parts = parts.union(wide.join(wholes, ["log", "at", "of"]).select("log", "position", "wholes"))
    repeats = parts.groupBy("log", "position").agg(F.sum("more").alias("repeats"))
    out = rows.join(repeats, ["log", "position"], "left")
    return out.select("log", "event_id", (F.col("position") - F.col("previous") - 1 - F.col("repeats")).alias("distance"))


def tiers(found: DataFrame, *sizes: int) -> DataFrame:
    """``found`` with the first tier that holds each access: of tiers with so many entries each, the last is without bound."""
    tier = F.lit(len(sizes) + 1)
    total = list(np.cumsum(sizes))
    for k in range(len(sizes), 0, -1):
        tier = F.when(F.col("distance") < int(total[k - 1]), k).otherwise(tier)
    return found.withColumn("tier", tier)
