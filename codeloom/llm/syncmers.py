"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is an anchor if the smallest hash among its inner s-mers is the
first's or the last's. Whether it is depends on the k-mer alone, so an edit changes no anchor
outside its own k-mers. A fingerprint keeps, for each of ``BINS`` classes of anchor hashes, 16 bits
of the smallest one and the rank of its first position among those of the other classes. Two texts
match by positions: of the classes with equal hashes those count that stand in the same order in
both texts (a longest chain), and their share of all classes that either text has is the likeness.
Insertions and cuts thus keep it, and moved passages lower it. :func:`matches` aligns two whole texts
by the offsets of all their anchors.

Texts are hashed in blocks, whole, however long. For the edited text of a document its successor
by doc_id is needed: rows are dealt into ranges of (doc_id, text hash), and the first row of each range
is also sent to the range before, so each text is shuffled once (and one a range twice), and no task sees
more than its ranges. Bounds come from quantiles of doc_id; an id, or none, that fills several ranges is
split by quantiles of its text hashes, and a text that does so under one id by row number.

Edge cases: a null text is empty; texts shorter than k bytes have one anchor, the text itself;
empty ones have none and are alike with each other only. Rows with equal doc_id are ordered by
the hash of their text; a null doc_id comes first. Repeated rows repeat. The only row of a table succeeds
itself. Empty tables give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import let, tidied

K, S = 16, 6
BINS = 128
EMPTY = 0xFFFF
BLOCK = 1 << 20
ROWS = 64
#: Numbers of ranges within one rank of ids, and most cuts of one id.
_SUB, _MOST = 1 << 24, 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a block of at least K bytes."""
    a1 = data.astype(np.uint64)
    a2 = a1[:-1] | a1[1:] << np.uint64(8)
    a4 = a2[:-2] | a2[2:] << np.uint64(16)
    h = _mix(a4[:-2] | a2[4:] << np.uint64(32))
    m = np.minimum(h[:-1], h[1:])
    m = np.minimum(m[:-2], m[2:])
    m = np.minimum(m[:-4], m[4:])
    m = np.minimum(m[:-3], m[3:])  # the least of K - S + 1 = 11
    n = len(m)
    at = np.flatnonzero((h[:n] == m) | (h[K - S :][:n] == m))
    low = a4[at] | a4[at + 4] << np.uint64(32)
    high = a4[at + 8] | a4[at + 12] << np.uint64(32)
    return at, _mix(_mix(low) + high)


def anchors_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of a text."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = np.frombuffer(data, np.uint8)
    if len(x) < K:
        own = hashlib.blake2b(data, digest_size=8).digest()
        return np.zeros(1, np.int64), np.frombuffer(own, np.uint64)
    found = [(k, *_block(x[k : k + BLOCK + K - 1])) for k in range(0, max(1, len(x) - K + 1), BLOCK)]
    return np.concatenate([k + at for k, at, _ in found]), np.concatenate([h for *_, h in found])


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row for each text: BINS 16-bit values, then the BINS ranks of their positions."""
    out = np.empty((len(texts), 2 * BINS), np.uint16)
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= BLOCK):
            n += len(texts[to])
            to += 1
        if n <= BLOCK:
            out[at:to] = _together(texts[at:to])
        else:
            pos, hashes = anchors_of(texts[at])
            out[at] = _values(np.zeros(len(pos), np.int64), pos, hashes, 1)[0]
        at = to
    return out


def _together(texts: list[bytes]) -> np.ndarray:
    """Sketches of short texts, hashed as one block; k-mers across texts are left out."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows, pos, hashes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) >= K:
        pos, hashes = _block(data)
        rows = np.searchsorted(ends, pos, side="right")
        inside = pos + K <= ends[rows]
        rows, pos, hashes = rows[inside], pos[inside], hashes[inside]
    short = [k for k in np.flatnonzero((sizes > 0) & (sizes < K))]
    if short:
        rows = np.concatenate([rows, short])
        pos = np.concatenate([pos, np.zeros(len(short), np.int64)])
        hashes = np.concatenate([hashes, *[anchors_of(texts[k])[1] for k in short]])
    return _values(rows, pos, hashes, len(texts))


def _values(rows: np.ndarray, pos: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    none = np.iinfo(np.uint64).max
    least = np.full(n * BINS, none, np.uint64)
    cell, own = rows * BINS + (hashes >> np.uint64(57)).astype(np.int64), hashes & np.uint64((1 << 57) - 1)
    np.minimum.at(least, cell, own)
    value = (_mix(least) >> np.uint64(40)) % np.uint64(EMPTY)
    value = np.where(least == none, EMPTY, value).astype(np.uint16).reshape(n, BINS)
    first = np.full(n * BINS, np.iinfo(np.int64).max)
    hit = own == least[cell]
    np.minimum.at(first, cell[hit], pos[hit])
    order = first.reshape(n, BINS).argsort(1, kind="stable")
    rank = np.empty((n, BINS), np.uint16)
    np.put_along_axis(rank, order, np.arange(BINS, dtype=np.uint16)[None, :], 1)
    return np.concatenate([value, np.where(value == EMPTY, 0, rank)], 1)


def _chain(places: list[int]) -> int:
    """The length of the longest increasing subsequence."""
    ends: list[int] = []
    for x in places:
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of equal classes in the same order among those that either has; 1 where both have none."""
    x, y = a[:, :BINS], b[:, :BINS]
    used = (x != EMPTY) | (y != EMPTY)
    same = (x == y) & used
    n = used.sum(-1)
    out = np.ones(len(a))
    for k in range(len(a)):
        if n[k]:
            own, other = a[k, BINS:][same[k]], b[k, BINS:][same[k]]
            out[k] = _chain(other[own.argsort()].tolist()) / n[k]
    return out


def to_hex(sketch: np.ndarray) -> list[str]:
    """The values, then the ranks as bytes."""
    return [r[:BINS].astype(">u2").tobytes().hex() + r[BINS:].astype(np.uint8).tobytes().hex() for r in sketch]


def from_hex(value: str) -> np.ndarray:
    data = bytes.fromhex(value)
    return np.concatenate([np.frombuffer(data, ">u2", BINS), np.frombuffer(data, np.uint8, BINS, 2 * BINS)]).astype(np.uint16)


def matches(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Positions (in a, in b) of anchors that occur once in either text and are shared: an alignment."""
    found = []
    for text in (a, b):
        pos, h = anchors_of(text)
        values, first, n = np.unique(h, return_index=True, return_counts=True)
        found.append(dict(zip(values[n == 1].tolist(), pos[first[n == 1]].tolist())))
    return sorted((p, found[1][h]) for h, p in found[0].items() if h in found[1])


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


@tidied
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text, range, guest); a guest ends its range as the last row's successor."""
    held: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                yield from zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")))

    def flush(pairs: list[tuple]) -> pa.RecordBatch:
        own = [t.encode("utf-8", "surrogatepass") for _, t, _ in pairs]
        after = [n.encode("utf-8", "surrogatepass") for *_, n in pairs]
        new = [edited(t, n).encode("utf-8", "surrogatepass") for _, t, n in pairs]
        a, e = sketches(own), sketches(new)
        # The successor of a row is mostly the next row, whose sketch is at hand.
        n = sketches([after[-1]])
        n = np.concatenate([a[1:], n])
        for k in [k for k in range(len(own) - 1) if after[k] != own[k + 1]]:
            n[k] = sketches([after[k]])[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, *_ in pairs], pa.int64()),
                pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                pa.array(to_hex(a)),
                pa.array(to_hex(e)),
                pa.array(np.round(likeness(a, e), 6)),
                pa.array(np.round(likeness(a, n), 6)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    pairs: list[tuple] = []
    size = 0
    for doc_id, text, place, guest in rows():
        if held:
            # A range without a guest is followed by more copies of its last text.
            pairs.append((*held[0][:2], text if held[0][2] == place else held[0][1]))
            size += len(text)
            held.clear()
        if not guest:
            held[:] = [(doc_id, text, place)]
        if size > BLOCK or len(pairs) >= 4 * ROWS:
            yield flush(pairs)
            pairs, size = [], 0
    if held:
        pairs.append((*held[0][:2], held[0][1]))
    if pairs:
        yield flush(pairs)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 4 * parts)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    ends = rows.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # At most one row for each range, whatever the input.
    ends = sorted((r["range"], tuple(r["first"]), tuple(r["last"])) for r in ends.collect())
    # The first row of a range succeeds the last of the range before, and that of the first the last of all.
    guests = [(r, *first[1:], ends[k - 1][0]) for k, (r, first, _) in enumerate(ends) if first != ends[k - 1][2]]
    slots = _slots(spark, parts)
    dealt_to = spark.createDataFrame([(r, slots[k % parts]) for k, (r, *_) in enumerate(ends)], "range long, slot long")
    return (
        _with_guests(rows, guests)
        .join(F.broadcast(dealt_to), "range")
        .repartition(parts, "slot")
        .sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "hash", "text")
        .select("doc_id", "text", "range", "guest")
        .mapInArrow(
            _compare,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )


def _slots(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that is hashed to it."""
    at = F.pmod(F.hash("id"), F.lit(parts))
    found = spark.range(64 * parts).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()
    known = {r["at"]: r["id"] for r in found}
    return [known.get(p, p) for p in range(parts)]


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, text) with hash, and range: numbers in the order of (doc_id, hash), ``n`` or somewhat more."""
    spark = rows.sparkSession
    # Quantiles are kept as doubles, which hold 53 bits exactly; so ids beyond that are ordered, but not split by hash.
    rows = rows.withColumn("hash", F.shiftright(F.xxhash64("text"), 11))
    total, nulls, bounds = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()
    times = Counter(bounds or [])
    ids = sorted(times)
    hot = {i: t for i, t in times.items() if t > 1}
    if n * nulls > 1.5 * total:
        hot[None] = round(n * nulls / total)
    rank = F.coalesce(_rank(ids) + 1, F.lit(0)).cast("long") * _SUB
    if not hot:
        return rows.withColumn("range", rank)
    own = spark.createDataFrame([(i,) for i in hot], "hot_id long")
    q = min(max(hot.values()), _MOST)
    found = rows.select("doc_id", "hash").join(F.broadcast(own), F.col("doc_id").eqNullSafe(F.col("hot_id")))
    found = found.groupBy("hot_id").agg(F.percentile_approx("hash", [k / q for k in range(1, q)] or [0.5], 10_000).alias("cuts")).collect()
    # About as many cuts of an id as it fills ranges.
    cuts = [(r["hot_id"], r["cuts"][:: max(1, q // hot[r["hot_id"]])]) for r in found]
    rows = rows.join(F.broadcast(spark.createDataFrame(cuts, "hot_id long, cuts array<long>")), F.col("doc_id").eqNullSafe(F.col("hot_id")) & F.col("cuts").isNotNull(), "left")
    at = F.size(F.filter("cuts", lambda x: x <= F.col("hash")))
    # Rows of one text that several cuts fall on are copies: any of their ranges will do.
    copies = F.greatest(F.lit(1), F.size(F.filter("cuts", lambda x: x == F.col("hash"))))
    sub = at - F.pmod(F.xxhash64(F.monotonically_increasing_id()), copies)
    rows = rows.withColumn("range", rank + F.when(F.col("cuts").isNull(), F.lit(_SUB - 1)).otherwise(sub))
    return rows.select("doc_id", "text", "hash", "range")


def _rank(bounds: list[int]) -> Column:
    """How many bounds are at or below doc_id: a bisection over every ``ROWS``-th bound, then a look at those between."""

    def search(xs: list[int], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= xs[mid], search(xs, mid + 1, hi)).otherwise(search(xs, lo, mid))

    if len(bounds) <= ROWS:
        rank = search(bounds, 0, len(bounds))
    else:
        firsts = bounds[::ROWS]
        groups = [F.array(*[F.lit(x).cast("long") for x in bounds[k : k + ROWS]]) for k in range(0, len(bounds), ROWS)]

        def within(g: Column) -> Column:
            own = F.get(F.array(*groups), g - 1)
            return F.coalesce((g - 1) * ROWS + F.size(F.filter(own, lambda x: x <= F.col("doc_id"))), F.lit(0))

        rank = let(search(firsts, 0, len(firsts)), within)
    return F.when(F.col("doc_id").isNotNull(), rank)


def _with_guests(rows: DataFrame, guests: list[tuple]) -> DataFrame:
    """Each row in its own range, and the rows that begin a range also in the range before; one scan.

    ``guests``: of each such range its number, its first doc_id and hash, and the range before.
    """
    if not guests:
        return rows.withColumn("guest", F.lit(False))
    first = rows.sparkSession.createDataFrame(guests, "first_of long, guest_id long, guest_hash long, guest_range long")
    same = (F.col("range") == F.col("first_of")) & F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("hash") == F.col("guest_hash"))
    joined = rows.join(F.broadcast(first), same, "left")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    other = F.when(F.col("guest_range").isNotNull(), F.struct(F.col("guest_range").alias("range"), F.lit(True).alias("guest")))
    return joined.select("doc_id", "text", "hash", F.explode(F.array_compact(F.array(own, other))).alias("p")).select("doc_id", "text", "hash", "p.range", "p.guest")
