"""Nearest vectors by cosine: exact in blocks, and by an index of inverted lists over product-quantised residuals.

Queries are rows too, so many of them are searched at once. Both ways deal the vectors into blocks of about ``BLOCK``
rows by a hash and send each query to the blocks that it has to see; in a task the queries stream past one block after
the other as matrix products. The exact way sends every query to all blocks.

The index is fitted on at most ``SAMPLE`` rows, those with the smallest hashes (its only bound; every row is indexed):
coarse centroids, code books of the residuals, and the number of lists that a query probes, the smallest by which ``TARGET`` of the
nearest neighbours within the sample are found. A list that holds many rows is many blocks. Each block gives its ``KEEP``
best rows by code, and these are ranked again by their vectors. :func:`neighbors` then confirms them: a query sees whole every list whose
centroid and radius don't rule out a row as near as its k-th so far, so its result is exact; where directions are nearly random that is most lists.

Edge cases: vectors that are null, empty, of zero length or with null or non-finite entries are neither found nor asked;
all others must have one length, else an error is raised. Similarities are rounded to six decimals, and equal ones are in
order of id, so copies of a vector are found smallest id first. Repeated ids are rows of their own. Fewer rows than
asked for give all of them. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.runtime.scratch import cut, small

SAMPLE, TARGET = 20_000, 0.99
BLOCK, KEEP = 4096, 64
#: Rows of a list as fitted, most lists, parts of a code and their values.
LIST, LISTS, PARTS, VALUES = 512, 1024, 16, 256
#: Queries of one matrix product.
QUERIES = 256
BROADCAST_ROWS = 100_000
#: By how much a bound may miss a similarity of six decimals.
SLACK = 2e-6
FOUND = "query_id long, vec_id long, similarity double"


@dataclass(frozen=True)
class Index:
    """What the sample gave: coarse centroids, code books (part, value, entry), and lists probed by a query."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that have a direction, scaled to length 1 as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col(ident).cast("long").alias("id"), v.alias("v")).filter("v is not null").withColumn("norm", norm)
    return rows.filter("norm > 0 and not isnan(norm) and norm < double('infinity')").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best scores, equal ones (six decimals) in order of id."""
    near = np.arange(len(scores))
    if len(scores) > keep:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep] - 1e-6)
    return near[np.lexsort((ids[near], -np.round(scores[near], 6)))][:keep]


def _blocks(batches: Iterator[pa.RecordBatch], keep: int, index: Index | None) -> Iterator[pa.RecordBatch]:
    """Rows (list, block, is_query, id, v, code) sorted by the first three: each query's best of the block before it."""
    at, parts, base, own = None, [], None, None

    def rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = b.column(3).to_numpy()
        if index is None:
            return ids, _matrix(b.column(4))
        code = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)
        return ids, index.centroids[b.column(0).to_numpy()] + _decoded(code, index.books)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            key, asked = tuple(keys[low, :2]), keys[low, 2]
            if key != at:
                at, parts, base = key, [], None
            if not asked:
                parts.append(rows_of(batch.slice(low, high - low)))
                continue
            if base is None and parts:
                own, base = (np.concatenate(x) for x in zip(*parts))
                parts = []
            for k in range(low, high if base is not None else low, QUERIES):
                some = batch.slice(k, min(QUERIES, high - k))
                scores = _matrix(some.column(4)) @ base.T
                best = [_best(own, s, keep) for s in scores]
                query = np.repeat(some.column(3).to_numpy(), [len(x) for x in best])
                found = np.concatenate(best)
                score = np.concatenate([s[x] for s, x in zip(scores, best)])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(own[found]), pa.array(score)], ["query_id", "vec_id", "similarity"])


def _met(base: DataFrame, asked: DataFrame, keep: int, index: Index | None = None) -> DataFrame:
    """Each query's best rows of each block; both sides have list, block, id, v, code."""
    columns = ["list", "block", "is_query", "id", "v", "code"]
    both = base.withColumn("is_query", F.lit(0)).select(columns).union(asked.withColumn("is_query", F.lit(1)).select(columns))
    sorted_ = both.repartition("list", "block").sortWithinPartitions("list", "block", "is_query")
    return sorted_.mapInArrow(partial(_blocks, keep=keep, index=index), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, with their rank."""
    rounded = found.withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the ``k`` nearest of ``vectors`` to each of ``queries`` (both of :func:`usable`)."""
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("binary")
    base = vectors.select(F.lit(0).alias("list"), block.alias("block"), "id", "v", none.alias("code"))
    asked = queries.select(F.lit(0).alias("list"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", none.alias("code"))
    return _top(_met(base, asked, k), k)


# The index


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means of the sample's rows."""
    r = np.random.default_rng(seed)
    centroids = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """x with zeros added so that it falls into equal parts: (part, row, entry)."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2)


def _coded(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.stack([_nearest(x, b) for x, b in zip(_parts(residuals, len(books)), books)], 1).astype(np.uint8)


def _decoded(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([b[c] for c, b in zip(code.T, books)], 1)


def fit(vectors: DataFrame, target: float = TARGET, seed: int = 7) -> Index | None:
    """The index's parameters from the sample of ``vectors`` (of :func:`usable`); None of no rows."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()
    if not rows:
        return None
    x = np.array([r["v"] for r in rows])
    lists = max(1, min(LISTS, n // LIST, len(x) // 4))
    centroids = _means(x, lists, seed)
    residuals = x - centroids[_nearest(x, centroids)]
    books = np.stack([_means(p, min(VALUES, len(x)), seed) for p in _parts(residuals, PARTS)])
    at, asked = _nearest(x, centroids), x[:200]
    order = np.argsort(-(asked @ centroids.T - (centroids**2).sum(1) / 2), axis=1)
    place = np.argsort(order, axis=1)  # of each list among a query's
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1:11]
    needed = np.sort(np.take_along_axis(place, at[near], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else lists
    width = books.shape[2] * PARTS
    return Index(np.pad(centroids, ((0, 0), (0, width - centroids.shape[1]))), books, probes)


def _assigned(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    index: Index = held.value
    for b in batches:
        x = _padded(_matrix(b.column(1)), index)
        at = _nearest(x, index.centroids)
        code = _coded(x - index.centroids[at], index.books)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "list", "code"])


def _padded(x: np.ndarray, index: Index) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, index.centroids.shape[1] - x.shape[1])))


def _probed(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    index: Index = held.value
    for b in batches:
        x = _padded(_matrix(b.column(1)), index)
        scores = x @ index.centroids.T - (index.centroids**2).sum(1) / 2
        lists = np.argsort(-scores, axis=1)[:, : index.probes].astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(lists), pa.list_(pa.int32()))], ["id", "v", "lists"])


def build(vectors: DataFrame, index: Index) -> DataFrame:
    """(id, list, block, code) of every vector, stored."""
    held = vectors.sparkSession.sparkContext.broadcast(index)
    rows = cut(vectors.select("id", "v").mapInArrow(partial(_assigned, held=held), "id long, list int, code binary"))
    sizes = small(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), LISTS)
    return rows.join(sizes, "list").select("id", "list", F.pmod(F.xxhash64("id", "code"), F.col("blocks")).cast("int").alias("block"), "code", "blocks")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = np.einsum("ij,ij->i", _matrix(b.column(2)), _matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "vec_id", "similarity"])


def search(vectors: DataFrame, built: DataFrame, index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`exact`, from the lists that each query probes in the index ``built`` of ``vectors``."""
    held = vectors.sparkSession.sparkContext.broadcast(index)
    blocks = small(built.select("list", "blocks").distinct(), LISTS)
    wide = queries.select("id", "v").mapInArrow(partial(_probed, held=held), "id long, v array<double>, lists array<int>")
    probes = wide.select("id", "v", F.explode("lists").alias("list")).join(blocks, "list")
    asked = probes.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", F.lit(None).cast("binary").alias("code"))
    base = built.select("list", "block", "id", F.lit(None).cast("array<double>").alias("v"), "code")
    near = _met(base, asked, max(KEEP, k), index).select("query_id", "vec_id").distinct()
    x = vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("x"))
    q = small(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), BROADCAST_ROWS // 10)
    pairs = near.join(x, "vec_id").join(q, "query_id").select("query_id", "vec_id", "q", "x")
    return _top(pairs.mapInArrow(_ranked, FOUND), k)


def _placed(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """(id, v, list, far): each row's list and its distance from the centroid."""
    index: Index = held.value
    for b in batches:
        if b.num_rows:
            x = _padded(_matrix(b.column(1)), index)
            at = _nearest(x, index.centroids)
            far = np.sqrt(((x - index.centroids[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(far)], ["id", "v", "list", "far"])


def _able(batches: Iterator[pa.RecordBatch], held, radius: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, v, lists): the lists that can hold a row as near as the query's ``least``, as no row is nearer than centroid plus radius."""
    index: Index = held.value
    for b in batches:
        if b.num_rows:
            bound = _padded(_matrix(b.column(1)), index) @ index.centroids.T + radius
            lists = [np.flatnonzero(x).astype(np.int32) for x in bound >= b.column(2).to_numpy()[:, None] - SLACK]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "lists"])


def confirmed(vectors: DataFrame, index: Index, queries: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """``found`` made exact: each query sees whole every list that its k-th similarity so far doesn't rule out."""
    held = vectors.sparkSession.sparkContext.broadcast(index)
    rows = cut(vectors.select("id", "v").mapInArrow(partial(_placed, held=held), "id long, v array<double>, list int, far double"))
    sizes = cut(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("far").alias("radius")))
    radius = np.full(len(index.centroids), -np.inf)
    for r in sizes.collect():  # a row a list
        radius[r["list"]] = r["radius"]
    blocks = small(sizes.select("list", "blocks"), LISTS)
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).filter(F.col("n") >= k)
    asked = queries.join(least, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    wide = asked.mapInArrow(partial(_able, held=held, radius=radius), "id long, v array<double>, lists array<int>")
    none = F.lit(None).cast("binary").alias("code")
    probes = wide.select("id", "v", F.explode("lists").alias("list")).join(blocks, "list")
    asked = probes.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", none)
    base = rows.join(blocks, "list").select("list", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), "id", "v", none)
    return _top(_met(base, asked, k), k)


def neighbors(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries``: by a new index, then confirmed, so all are found."""
    index = fit(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    return confirmed(vectors, index, queries, search(vectors, build(vectors, index), index, queries, k), k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: how many of the ``wanted`` neighbours there are, and which share of them is as near in ``found``.

    A neighbour that is missing counts as found where another one of the same similarity stands in its place.
    """
    worst = wanted.groupBy("query_id").agg(F.min("similarity").alias("worst"))
    good = found.join(worst, "query_id").filter("similarity >= worst").agg(F.count("*").alias("good"))
    total = wanted.agg(F.count("*").alias("neighbors"))
    return total.crossJoin(F.broadcast(good)).select("neighbors", (F.least("good", "neighbors") / F.col("neighbors")).alias("recall"))  # one row each
