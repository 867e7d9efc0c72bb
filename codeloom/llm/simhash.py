"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits. Each bit position i gets a
non-zero vector m(i) of RADIUS + 1 bits; for each non-zero vector v a table masks the fingerprint
with the bits whose m(i) has odd overlap with v. Any RADIUS positions leave a v that is orthogonal
to all of them, so every pair within the radius is equal under some mask: no pair is missed.

Equal fingerprints are one class before any search. Buckets with one class are dropped, those with
up to ``BUCKET`` classes are searched as they are. A larger bucket is covered again on the bits
that its mask left free (about half remain each time), so after three levels at most 2**8 distinct
fingerprints can share a key: the size of every group that one task holds is bounded by
construction, and nothing is dropped. A bucket yields a spanning star of each of its components,
not its pairs. Components of many links are found by alternating large-star and small-star rounds on the
cluster, each round checkpointed in the shared folder; those of few, counted, links in one task.

Few pairs of texts at a Jaccard similarity of 0.8 are within three bits, so where a ``similarity`` is
given, pairs of texts whose sets of ``SIMILAR_WIDTH``-word shingles are at least that similar are
linked too. Candidates share one of ``BANDS`` bands of ``BAND`` minima (a pair at 0.8 shares none
with a probability of 3.2e-6, a closer one with less) and are confirmed by their exact sets
(:mod:`codeloom.llm.near_sets`).

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other. Texts of
one or two words have one shingle. Very long texts are hashed whole, in blocks. Repeated rows share a
fingerprint and a component. A null doc_id gives a row but is never a component's id unless it has no
other; doc_ids that repeat with other texts are rows like any other. Empty tables give empty results.
Extra columns, of whatever name, are ignored by :func:`components` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import near_sets
from codeloom.llm.common import cut, rows_of, tidied
from codeloom.llm.components import rooted, stars
from codeloom.llm.near_sets import shingles

RADIUS = 3
BUCKET = 1024
LEVELS = 3
SIMILAR_WIDTH = 5
BANDS, BAND = 24, 4
BROADCAST_ROWS = 100_000
ALL = (1 << 64) - 1


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    h = shingles(text, width, seed)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@tidied
def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        found = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], ["doc_id", "fp", "own"])


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    a, b = r.integers(0, 1 << 64, (2, BANDS * BAND), np.uint64)
    return a | np.uint64(1), b


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of minima of a set of shingles; none of the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    a, b = _permutations()
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        np.minimum(least, (own[k : k + 512, None] * a + b).min(0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, BAND).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


@tidied
def _banded(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        texts = b.column(1).to_pylist()
        found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, b.num_rows)
        keys = pa.array([bands(np.unique(shingles(t, SIMILAR_WIDTH))) for t in texts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2), keys], ["doc_id", "fp", "own", "bands"])


def similar_links(docs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Links (a < b) among the fingerprints of texts at ``similarity`` or more; ``prints`` has doc_id, fp, own, bands.

    Each member of a bucket is a candidate with the bucket's smallest, its pivot; :func:`near_sets.link_texts` confirms
    them and compares the members that stand apart.
    """
    texts = cut(prints.groupBy("own").agg(F.min("doc_id").alias("first_id"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    keys = texts.select("own", F.posexplode("bands").alias("band", "key")).select("own", F.xxhash64("band", "key").alias("bucket"))
    edges = near_sets.link_texts(docs, texts, near_sets.pivoted(keys), near_sets.fellows(keys), SIMILAR_WIDTH, similarity)
    prints_of = texts.select("own", "fp")
    ends = edges.join(prints_of.select(F.col("own").alias("a"), F.col("fp").alias("p")), "a").join(prints_of.select(F.col("own").alias("b"), F.col("fp").alias("q")), "b")
    return cut(ends.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())


@lru_cache(maxsize=1 << 16)
def masks(fixed: int = 0, radius: int = RADIUS) -> tuple[int, ...]:
    """The covering masks over the bits that aren't in ``fixed``, each with ``fixed`` added."""
    n, at, vector = (1 << (radius + 1)) - 1, 0, {}
    for i in range(64):
        if not fixed >> i & 1:
            vector[i], at = at % n + 1, at + 1
    return tuple(fixed | sum(1 << i for i, m in vector.items() if (m & v).bit_count() % 2) for v in range(1, n + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@tidied
def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp) under each finer mask."""
    for b in batches:
        mask, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for m in np.unique(mask):
            own = fp[mask == m]
            for x in masks(int(m) & ALL):
                x = np.int64(_signed(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x)), pa.array(own & x), pa.array(own)], ["mask", "key", "fp"])


def _stars(values: list[int]) -> list[tuple[int, int]]:
    """A star (smallest, other) for each component of distinct fingerprints at ``RADIUS`` or fewer bits."""
    if len(values) == 2:
        a, b = sorted(values)
        return [(a, b)] if ((a ^ b) & ALL).bit_count() <= RADIUS else []
    x = np.sort(np.array(values, np.int64))
    near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= RADIUS
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(x[r]), int(v)) for r, v in zip(label, x) if x[r] != v]


@tidied
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [e for values in b.column(0).to_pylist() for e in _stars(values)]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], ["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """Spanning links (a < b) among distinct fingerprints ``fp``, checkpointed."""
    fp = F.col("fp")
    level = [F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks()]
    rows = classes.select("fp", F.explode(F.array(*level)).alias("t")).select("t.mask", "t.key", "fp")
    found = None
    for depth in range(1, LEVELS + 1):
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = cut(rows.join(sizes, ["mask", "key"]))
        small = rows.filter(F.col("n") <= BUCKET) if depth < LEVELS else rows
        pairs = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_links, "a long, b long")
        found = pairs if found is None else found.union(pairs)
        large = rows.filter(F.col("n") > BUCKET)
        if depth == LEVELS or large.isEmpty():
            break
        rows = large.select("mask", "fp").mapInArrow(_finer, "mask long, key long, fp long")
    return cut(found.distinct())


def _classes(docs: DataFrame, width: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, own) of all documents, and (fp, root) of all fingerprints; ``own`` is the text's hash."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    if similarity is None:
        prints = cut(rows.mapInArrow(partial(_fingerprints, width=width), "doc_id long, fp long, own long"))
    else:
        prints = cut(rows.mapInArrow(partial(_banded, width=width), "doc_id long, fp long, own long, bands array<long>"))
    classes = prints.select("fp").distinct()
    edges = links(classes)
    if similarity is not None:
        edges = edges.union(similar_links(docs, prints, similarity))
    return prints.select("doc_id", "fp", "own"), cut(rooted(classes, stars(edges), "fp"))


def components(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    With ``similarity``, texts at that Jaccard similarity of ``SIMILAR_WIDTH``-word shingles are linked too.
    """
    prints, classes = _classes(docs, width, similarity)
    rooted = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")).join(classes, "fp")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component, with all columns: the first by doc_id (rows without one come last) and text hash.

    Rows are told apart by doc_id and text, so an id may repeat with other texts, and any or all may be null. Only
    keys meet before the end; then the rows that go are looked up by key, and broadcast where they are few.
    """
    prints, classes = _classes(docs, width, similarity)
    keys = cut(prints.groupBy("fp", F.col("doc_id").alias("__id"), F.col("own").alias("__own")).agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "__own", "n"))
    best = keys.groupBy("fp").agg(first.alias("k")).join(classes, "fp").groupBy("root").agg(F.min("k").alias("k"))
    best = cut(best.select("k.__id", "k.__own", "k.n"))
    same = F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__own") == F.col("r.__own"))

    def lookup(rows: DataFrame) -> DataFrame:
        return (F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows).alias("r")

    gone = cut(keys.select("__id", "__own").alias("l").join(best.alias("r"), same, "left_anti"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__own"))
    rows = rows.alias("l").join(lookup(gone), same, "left_anti")
    twice = best.filter("n > 1").select("__id", "__own")
    if not twice.isEmpty():
        # Repeats of a row that stays: one of them.
        marked = rows.alias("l").join(lookup(twice.withColumn("__twice", F.lit(True))), same, "left").select("l.__row", "l.__id", "l.__own", "__twice")
        once = marked.filter("__twice").dropDuplicates(["__id", "__own"])
        rows = marked.filter("__twice is null").union(once)
    return rows.select("__row.*")
