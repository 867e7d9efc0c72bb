"""Connected components of links: ``stars`` of (a, b), and ``rooted``, which looks a column's roots up."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, tidied
from codeloom.runtime.scratch import renewed

#: Edges that one task joins, 16 bytes each; beyond it, rounds on the cluster do.
FEW_EDGES = 250_000
#: Rounds between which the links are stored anew, so that their size is known.
RENEW = 5


@tidied
def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    ends = np.concatenate([np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in own], axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    for k in range(0, len(other), 10_000):
        part = other[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["node", "root"])


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is a component's smallest node.

    Up to ``FEW_EDGES`` (counted) are joined in one task, without a shuffle; more in rounds on the cluster.
    """
    if edges.count() <= FEW_EDGES:
        return cut(edges.select("a", "b").coalesce(1).mapInArrow(_one_task, "node long, root long"))

    def unlike(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    for k in count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = unlike(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = renewed(unlike(small)) if k % RENEW == RENEW - 1 else cut(unlike(small))
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def rooted(rows: DataFrame, roots: DataFrame, name: str, out: str = "root") -> DataFrame:
    """``rows`` with ``out``, the smallest node of the component of ``name``; ``roots`` are those of :func:`stars`."""
    found = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(found, F.col(name) == F.col("__node"), "left").withColumn(out, F.coalesce("__root", name)).drop("__node", "__root")
