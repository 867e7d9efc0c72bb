"""Links of texts whose sets of word shingles are similar, exact among candidates, without all pairs of a bucket.

Candidates come as (own, pivot): each member of a bucket with the bucket's smallest; all members of one pivot are a
group. Links are confirmed by the sets in steps, each leaving out what the links before have joined:

1. each text meets one of its pivots;
2. in rounds, members outside their group's largest component meet a few of the texts that they share most buckets with,
   others each round, until a round joins few of them: near copies of one text soon find one that is near enough;
3. members that still stand apart from the largest component meet all others of their group of another component, but only those of
   a size that allows the similarity, and with which they share one of the rarest elements of both: ordered by
   frequency, two sets at similarity s have an element in common among the first n - ceil(s n) + 1 of each. Texts that
   share a frequent passage and differ in the rest have none there, so a group of such texts gives few pairs or none.
   Where that leaves more pairs than it would take to send sets, as among hundreds of copies of one text that are all just
   below the similarity, those that stand apart are held in blocks of ``TEXTS`` and the group streams past each block.

So every pair of a group that could still join two components is compared. What remains quadratic is the comparison of texts
that stand apart and share rare elements with most of their group, at a 256th of the rows. A set that many are compared
with is sent once for each ``BLOCK`` elements of theirs, and is compared with them as they stream by: no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Stored, cut, rows_of, tidied
from codeloom.llm.components import rooted, stars
from codeloom.runtime.scratch import small

BROADCAST_ROWS = 100_000
#: Elements of the sets that one copy of a set is compared with; rows of one vectorised comparison.
BLOCK, ROWS = 1 << 20, 256
#: Fellows that a text which stands apart meets in a round, how many rounds there are at most, and the share of new links below
#: which no other follows; expected members of a part of a bucket.
FELLOWS, ROUNDS, FRUITFUL, PART = 8, 1, 0.05, 4
#: Texts, and elements of theirs, that are held as one block; texts that stream past a block in one task.
TEXTS, STREAM = 256, 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    found = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), "<u8", max(1, len(words) - width + 1))


@tidied
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        found = [np.unique(shingles(t, width)).view(np.int64) for t in b.column(1).to_pylist()]
        sizes = pa.array([len(x) for x in found], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(found, pa.list_(pa.int64()))], ["own", "n", "shingles"])


@tidied
def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links in rows (a, b, shingles); each row without b holds the set of a for the rows after it."""
    first, own = None, None
    for batch in batches:
        for part in rows_of([batch], ROWS):
            if not part.num_rows:
                continue
            a, heads, lists = part.column(0).to_numpy(zero_copy_only=False), np.asarray(part.column(1).is_null()), part.column(2)
            bounds = [0, *np.flatnonzero(heads).tolist(), part.num_rows]
            for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                if k:
                    first, own = a[low], lists[low].values.to_numpy().view(np.uint64)
                    low += 1
                if low >= high:
                    continue
                rows = lists.slice(low, high - low)
                sizes = rows.value_lengths().to_numpy()
                values = rows.flatten().to_numpy().view(np.uint64)
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                near = both >= similarity * (len(own) + sizes - both) - 1e-9
                if near.any():
                    other = part.column(1).slice(low, high - low).filter(pa.array(near))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), first)), other], ["a", "b"])


def _possible(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m elements can be that similar."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - F.lit(1e-9)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (own, n, shingles) are similar enough, materialised."""
    sizes = sets.select("own", "n")
    first, other = sizes.toDF("a", "n"), sizes.toDF("b", "m")
    sized = cut(pairs.join(other, "b").join(first, "a").filter(_possible(F.col("n"), F.col("m"), similarity)).select("a", "b", "m"))
    parts = sized.groupBy("a").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("parts"))
    parts = small(cut(parts), BROADCAST_ROWS)
    heads = parts.join(sets.select(F.col("own").alias("a"), "shingles"), "a")
    heads = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    members = sized.join(parts, "a").join(sets.select(F.col("own").alias("b"), "shingles"), "b")
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "shingles")
    rows = heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())
    return cut(rows.select("a", "b", "shingles").mapInArrow(partial(_compared, similarity=similarity), "a long, b long"))


def pivoted(keys: DataFrame) -> DataFrame:
    """Distinct (own, pivot) of the buckets in ``keys`` (own, bucket): their members, but for the smallest, with that."""
    pivots = keys.groupBy("bucket").agg(F.min("own").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return cut(keys.join(pivots, "bucket").filter("own <> pivot").select("own", "pivot").distinct())


def grouped(keys: DataFrame) -> DataFrame:
    """Distinct (own, pivot) of the groups in ``keys`` (own, half, bucket): buckets of one half that share members are one.

    The pivot is the group's smallest member, so each has at most one a half.
    """
    pivots = keys.groupBy("half", "bucket").agg(F.min("own").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = cut(keys.join(pivots, ["half", "bucket"]).groupBy("half", "own").agg(F.collect_set("pivot").alias("pivots")))
    least = rows.withColumn("first", F.array_min("pivots"))
    links = least.select("half", "first", F.explode("pivots").alias("pivot")).filter("pivot <> first").distinct()
    roots = stars(links.select(F.xxhash64("half", "first").alias("a"), F.xxhash64("half", "pivot").alias("b")))
    named = cut(rooted(least.select("own", F.xxhash64("half", "first").alias("node")), roots, "node"))
    pivots = named.groupBy("root").agg(F.min("own").alias("pivot"))
    return cut(named.join(pivots, "root").filter("own <> pivot").select("own", "pivot").distinct())


def fellows(keys: DataFrame) -> DataFrame:
    """(own, fellow, weight): each member of a bucket in ``keys`` (own, bucket) with the smallest of its part of it.

    Parts are dealt by a hash, ``PART`` members each on average; the weight is the number of parts that two share.
    """
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 2")
    part = F.xxhash64("bucket", F.pmod(F.xxhash64("own", F.lit(1)), F.ceil(F.col("n") / PART)))
    rows = cut(keys.join(sizes, "bucket").select("own", part.alias("part")))
    first = rows.groupBy("part").agg(F.min("own").alias("fellow"))
    return cut(rows.join(first, "part").filter("own <> fellow").groupBy("own", "fellow").agg(F.count("*").alias("weight")))


def near_links(met: DataFrame, fellows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar sets among the candidates ``met`` (own, pivot) and their fellow members.

    ``fellows`` (own, fellow, weight) are what members that stand apart meet first, the heaviest first.
    """
    one = met.groupBy("own").agg(F.min("pivot").alias("pivot"))
    tried = cut(one.select(F.col("pivot").alias("a"), F.col("own").alias("b")))
    edges = confirmed(tried, sets, similarity)
    # A group of one pair is done where that was the pair compared.
    left = met.join(one.withColumnRenamed("pivot", "first"), "own").groupBy("pivot").agg(F.count("*").alias("n"), F.bool_or(F.col("first") != F.col("pivot")).alias("open"))
    pivots = left.filter("n > 1 or open").select("pivot")
    members = cut(met.join(pivots, "pivot").select("own", "pivot").union(pivots.select(F.col("pivot").alias("own"), "pivot")))
    near = fellows.union(fellows.select(F.col("fellow").alias("own"), F.col("own").alias("fellow"), "weight"))
    near = near.union(met.select("own", F.col("pivot").alias("fellow"), F.lit(1)))
    near = near.groupBy("own", "fellow").agg(F.sum("weight").alias("weight"))
    heaviest = Window.partitionBy("own").orderBy(F.desc("weight"), "fellow")
    near = cut(near.withColumn("r", F.row_number().over(heaviest)).filter(F.col("r") <= FELLOWS * max(ROUNDS, 1)).drop("r"))
    for _ in range(ROUNDS):
        roots = stars(edges)
        rows = cut(_apart(members, roots))
        alone = rows.filter("apart").select("own").distinct()
        pairs = cut(_some(near, alone, roots, tried))
        n = pairs.count()
        if not n:
            break
        tried = tried.union(pairs)
        found = confirmed(pairs, sets, similarity)
        edges = edges.union(found)
        if found.count() < FRUITFUL * n:
            break
    rows = cut(_apart(members, stars(edges)))
    if rows.filter("apart").isEmpty():
        return edges
    pairs, dense = _fellows(rows, sets, similarity)
    edges = edges.union(confirmed(pairs.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"), sets, similarity))
    return edges if dense.isEmpty() else edges.union(_in_blocks(dense, sets, similarity))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (own, pivot) with their root, and ``apart``: whether it is another than that of most of the group.

    Groups whose pivots are in one component are one, by the component's root.
    """
    rows = rooted(rooted(members, roots, "own"), roots, "pivot", "of").select("own", F.col("of").alias("pivot"), "root").distinct()
    sizes = rows.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("pivot").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    return rows.join(most, "pivot").select("own", "pivot", "root", (F.col("root") != F.col("main")).alias("apart"))


def _some(near: DataFrame, alone: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """Distinct new pairs (a, b): the texts ``alone`` with the heaviest of their fellows in other components."""
    mine = near.join(alone, "own").select("own", "fellow", "weight")
    both = rooted(rooted(mine, roots, "own"), roots, "fellow", "of").filter("root <> of")
    pairs = both.select("own", "weight", F.greatest("own", "fellow").alias("a"), F.least("own", "fellow").alias("b"))
    met = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    new = pairs.join(met, ["a", "b"], "left_anti")
    w = Window.partitionBy("own").orderBy(F.desc("weight"), "a", "b")
    return new.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= FELLOWS).select("a", "b").distinct()


def _fellows(rows: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of step 3, and the members of groups with too many of them; ``rows``: own, pivot, root, apart."""
    open_ = rows.filter("apart").select("pivot").distinct()
    own = cut(rows.join(open_, "pivot").select("own", "pivot", "root", "apart"))
    tokens = sets.join(own.select("own").distinct(), "own").select("own", "n", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # Elements of one set only come first in the order; what is left of the prefix is of the others, the rarest first.
    ranked = tokens.join(common, "token").groupBy("own", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    reach = F.greatest(prefix - (F.col("n") - F.size("t")), F.lit(0))
    rare = ranked.select("own", "n", F.explode(F.slice("t", F.lit(1), reach)).alias("x")).select("own", "n", "x.token")
    marked = cut(own.join(rare, "own"))
    met = marked.groupBy("pivot", "token").agg(F.count_if("apart").alias("x"), F.count("*").alias("y")).filter("x > 0 and y > 1")
    sizes = own.groupBy("pivot").agg(F.count_if("apart").alias("aside"), F.count("*").alias("n"))
    cost = F.col("n") * F.ceil(F.col("aside") / TEXTS) + F.col("aside") * F.ceil(F.col("n") / STREAM)
    pairs = met.groupBy("pivot").agg(F.sum(F.col("x") * F.col("y")).alias("pairs")).join(sizes, "pivot")
    kinds = cut(pairs.select("pivot", (F.col("pairs") > cost).alias("dense")))
    sparse = marked.join(small(kinds.filter("not dense").select("pivot"), BROADCAST_ROWS), "pivot")
    x = sparse.filter("apart").select("pivot", "token", F.col("own").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"))
    y = sparse.select("pivot", "token", F.col("own").alias("a"), "n", "root", "apart")
    # Of two that stand apart one order is enough.
    both = y.join(x, ["pivot", "token"]).filter((F.col("root") != F.col("r")) & (~F.col("apart") | (F.col("a") < F.col("b"))) & _possible(F.col("n"), F.col("m"), similarity))
    # Who has no element left in reach is in no pair.
    able = marked.select("own", "pivot").distinct()
    return cut(both.select("a", "b").distinct()), cut(own.join(kinds.filter("dense").select("pivot"), "pivot").join(able, ["own", "pivot"]))


@tidied
def _across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links in rows (group, i, j, own, root, streams, shingles) sorted by group, i, j, streams: of a block with what streams past it."""
    at, held, block = None, [], None
    for batch in batches:
        for part in rows_of([batch], 32):
            if not part.num_rows:
                continue
            keys = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 5)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if tuple(keys[low, :3]) != at:
                    at, held, block = tuple(keys[low, :3]), [], None
                lists = part.column(6).slice(low, high - low)
                sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                own, root = (part.column(k).slice(low, high - low).to_numpy() for k in (3, 4))
                if not keys[low, 3]:
                    held.append((own, root, sizes, values))
                    continue
                if block is None and held:
                    o, r, n, v = (np.concatenate(x) for x in zip(*held))
                    order, of = np.argsort(v, kind="stable"), np.repeat(np.arange(len(o)), n)
                    block, held = (o, r, n, v[order], of[order]), []
                if block is not None:
                    yield _hits(block, own, root, sizes, values, similarity)


def _hits(block: tuple, own: np.ndarray, root: np.ndarray, sizes: np.ndarray, values: np.ndarray, similarity: float) -> pa.RecordBatch:
    ids, roots, lengths, tokens, of = block
    low, high = np.searchsorted(tokens, values, "left"), np.searchsorted(tokens, values, "right")
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    row = np.repeat(np.repeat(np.arange(len(own)), sizes), n)
    both = np.bincount(row * len(ids) + of[at], minlength=len(own) * len(ids)).reshape(len(own), len(ids))
    near = (both >= similarity * (sizes[:, None] + lengths[None] - both) - 1e-9) & (root[:, None] != roots[None])
    y, x = np.nonzero(near)
    return pa.RecordBatch.from_arrays([pa.array(own[y]), pa.array(ids[x])], ["a", "b"])


def _in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of those ``apart`` with all members (own, pivot, root, apart) of their group, block by block."""
    sized = members.join(sets.select("own", "n"), "own")
    blocks = F.greatest(F.ceil(F.count_if("apart") / TEXTS), F.ceil(F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0)) / BLOCK), F.lit(1)).cast("int")
    streams = F.greatest(F.ceil(F.count("*") / STREAM), F.ceil(F.sum("n") / (16 * BLOCK))).cast("int")
    shape = cut(sized.groupBy("pivot").agg(blocks.alias("blocks"), streams.alias("streams")))
    rows = sized.join(small(shape, BROADCAST_ROWS), "pivot")

    def dealt(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("own", F.lit(salt)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = rows.filter("apart").select("pivot", dealt(1, "blocks").alias("i"), every("streams").alias("j"), "own", "root", F.lit(0).alias("past"))
    past = rows.select("pivot", every("blocks").alias("i"), dealt(2, "streams").alias("j"), "own", "root", F.lit(1).alias("past"))
    both = held.union(past).join(sets.select("own", "shingles"), "own").select("pivot", "i", "j", "own", "root", "past", "shingles")
    sorted_ = both.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "past")
    return cut(sorted_.mapInArrow(partial(_across, similarity=similarity), "a long, b long"))


def link_texts(docs: DataFrame, texts: DataFrame, met: DataFrame, fellows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) among texts (own, first_id) whose sets of ``width``-word shingles are similar.

    ``met`` (own, pivot) and ``fellows`` are those of :func:`near_links`. ``own`` is xxhash64 of a text, ``first_id`` the smallest doc_id that has it; of copies the first one's text is read.
    """
    members = met.select("own").union(met.select("pivot")).distinct()
    wanted = cut(texts.select("own", "first_id").join(members, "own"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__own"))
    rows = keyed.join(small(wanted, BROADCAST_ROWS), (F.col("__own") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    stored = Stored(rows.select("own", "text").mapInArrow(partial(_sets, width=width), "own long, n int, shingles array<long>").dropDuplicates(["own"]))
    edges = near_links(met, fellows, stored.df, similarity)
    stored.free()
    return edges
