"""MinHash near-duplicates by tensored banding.

A document's set is that of its distinct ``WIDTH``-word shingles. Two small collections of ``HALVES`` half keys, each
of ``MINIMA`` minima, are computed for it, and the keys of ``HALVES`` squared tables are all pairs of a half key of the
first collection and one of the second: 256 tables of six minima from 96 minhashes instead of 1,536. Two
sets share a table if they share a half key in each collection, so a pair at similarity 0.8 is missed by all tables with a
probability of 2.1e-5 (2 (1 - 0.8**3)**16), at 0.85 with 5.7e-7. Candidates are confirmed on the full sets
(:mod:`codeloom.llm.near_sets`).

The tables are never shuffled as such: a text goes to each of its first half keys with all its second ones, and the
pairs are formed where the texts of one first half key meet, each member with the table's smallest, its pivot. Tables of one
first half key that share members are one group with one pivot, so a text has at most ``HALVES`` pivots, not one for each of
its tables. First half keys of more than ``LIGHT`` texts, as those of a large group of near copies, aren't gathered: there the full keys
are made and reduced to pivots before they are shuffled.

Edge cases: a null, empty or blank text has the empty set, is linked with nothing and is its own component. A text of
one word has one shingle, the word. Very long texts are hashed whole; their sets of hashes are held one at a time. Texts
are one class if they are the same; different texts of one set link at similarity 1. Rows that repeat an id are told
apart by their texts; a null doc_id is never a component's id unless it has no other, then it is null. Ties: the smallest id.
Empty tables give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import near_sets
from codeloom.llm.common import cut, rows_of, tidied
from codeloom.llm.components import rooted, stars
from codeloom.runtime.scratch import small

WIDTH, SIMILARITY = 2, 0.8
HALVES, MINIMA = 16, 3
#: Texts of one first half key that meet in one task.
LIGHT = 10_000
BROADCAST_ROWS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(12)
    a, b = r.integers(0, 1 << 64, (2, 2 * HALVES * MINIMA), np.uint64)
    return a | np.uint64(1), b


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return (x ^ (x >> np.uint64(32))) * MIX


def half_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half keys of both collections of a set of hashes; none of the empty set."""
    if not len(own):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    a, b = _permutations()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        np.minimum(least, (own[k : k + 512, None] * a + b).min(0), out=least)
    keys = np.arange(2 * HALVES, dtype=np.uint64)
    for x in least.reshape(2 * HALVES, MINIMA).T:
        keys = mixed(keys ^ x)
    return keys[:HALVES].view(np.int64), (keys[HALVES:] >> np.uint64(32)).astype(np.uint32).view(np.int32)


@tidied
def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        sets = [np.unique(near_sets.shingles(t, width)) for t in b.column(1).to_pylist()]
        keys = [half_keys(s) for s in sets]
        columns = [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.list_(pa.int64())), pa.array([k for _, k in keys], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "n_shingles", "first", "second"])


def _joined(order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The smallest member that each one's tables lead to; ``order`` are the members' keys by table, ``begins`` where one starts."""
    starts, table = np.flatnonzero(begins), np.cumsum(begins) - 1
    root, of = np.arange(len(order) // HALVES), np.empty(len(order), np.int64)
    while True:
        of[order] = np.minimum.reduceat(root[order // HALVES], starts)[table]
        new = of.reshape(-1, HALVES).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _met(rows: pa.RecordBatch, grouped: bool) -> pa.RecordBatch:
    """(own, other, weight) of the tables of whole first half keys; ``rows`` are sorted by half, own.

    Each member with the smallest of a table, or of its group of tables (weight 0), and with the member before it in most
    of its tables, of one half key, and their number.
    """
    half, own = (rows.column(k).to_numpy().view(np.uint64) for k in (0, 1))
    second = rows.column(2).flatten().to_numpy().view(np.uint32).reshape(-1, HALVES).astype(np.uint64)
    tables = mixed(half[:, None] ^ mixed(second + (np.arange(HALVES, dtype=np.uint64) << np.uint64(32)))).ravel()
    order = np.argsort(tables, kind="stable")
    member, table = order // HALVES, tables[order]
    begins = np.ones(len(table), bool)
    begins[1:] = table[1:] != table[:-1]
    if grouped:
        each, pivot = np.arange(len(own)), _joined(order, begins)
    else:
        each, pivot = member, member[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    stars = np.unique(np.stack([each, pivot], 1)[each != pivot], axis=0)
    at = np.flatnonzero(~begins)
    pairs, weight = np.unique(np.stack([member[at], member[at - 1]], 1), axis=0, return_counts=True)
    best = np.lexsort((-weight, pairs[:, 0]))
    best = best[np.unique(pairs[best, 0], return_index=True)[1]]
    found = own[np.concatenate([stars, pairs[best]])].view(np.int64)
    weights = np.concatenate([np.zeros(len(stars), np.int64), weight[best]])
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(weights)], ["own", "other", "weight"])


@tidied
def _tensored(batches: Iterator[pa.RecordBatch], grouped: bool) -> Iterator[pa.RecordBatch]:
    """Batches sorted by half, own; the rows of the last half key of a batch wait for the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        half = b.column(0).to_numpy()
        if not len(half):
            continue
        cuts = np.flatnonzero(half[1:] != half[:-1]) + 1
        if held and held[0].column(0)[0].as_py() != half[0]:
            yield _met(pa.concat_batches(held), grouped)
            held = []
        if not len(cuts):
            held.append(b)
            continue
        yield _met(pa.concat_batches([*held, b.slice(0, cuts[-1])]), grouped)
        held = [b.slice(cuts[-1])]
    if held:
        yield _met(pa.concat_batches(held), grouped)


def candidates(texts: DataFrame, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of texts (own, first, second) that share a table: (own, pivot), with the table's smallest, and fellows (own, fellow, weight).

    If ``grouped``, tables of one first half key that share members have one pivot, the smallest of all.
    """
    halves = texts.select(F.explode("first").alias("half"), "own", "second")
    heavy = cut(halves.groupBy("half").agg(F.count("*").alias("n")).filter(F.col("n") > LIGHT).select("half"))
    few = small(heavy, BROADCAST_ROWS)
    light = halves.join(few, "half", "left_anti").repartition("half").sortWithinPartitions("half", "own")
    found = cut(light.mapInArrow(partial(_tensored, grouped=grouped), "own long, other long, weight long"))
    met = found.filter("weight = 0").select("own", F.col("other").alias("pivot"))
    fellows = found.filter("weight > 0").toDF("own", "fellow", "weight")
    if not heavy.isEmpty():
        wide = halves.join(few, "half", "left_semi").select("own", "half", F.posexplode("second").alias("j", "k"))
        keys = wide.select("own", "half", F.xxhash64("half", "j", "k").alias("bucket"))
        pivots = near_sets.grouped(keys) if grouped else near_sets.pivoted(keys.drop("half"))
        met, fellows = met.union(pivots), fellows.union(near_sets.fellows(keys.drop("half")))
    return cut(met.distinct()), fellows.groupBy("own", "fellow").agg(F.sum("weight").alias("weight"))


def components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_shingles (of its set), component_id (the smallest doc_id reachable), kept (it is its own)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    prints = cut(rows.mapInArrow(partial(_hashed, width=width), "doc_id long, own long, n_shingles long, first array<long>, second array<int>"))
    full = prints.filter("n_shingles > 0")
    texts = full.groupBy("own").agg(F.min("doc_id").alias("first_id"), F.any_value("first").alias("first"), F.any_value("second").alias("second"))
    texts = cut(texts)
    met, fellows = candidates(texts.select("own", "first", "second"), grouped=True)
    edges = near_sets.link_texts(docs, texts, met, fellows, width, similarity)
    classes = rooted(texts.select("own", "first_id"), stars(edges), "own")
    least = classes.groupBy("root").agg(F.min("first_id").alias("least_id"))
    known = classes.join(least, "root").select("own", "least_id")
    full_rows = full.join(known, "own").select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))
    alone = prints.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full_rows.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
