"""Periodic runs of words: stretches that repeat themselves at some distance.

A run is a stretch of words with smallest period q (words q apart are the same) of at least max(``LEAST``, 2 q)
words that no neighbour extends with that period. A run of period p holds a grid point i, a multiple of p, within its
first p words, where word i is word i + p. So for all periods p up to half the text, all grid points i at distance p
(n/1 + n/2 + ... pairs, about n ln n) are taken together: of pairs with equal words the longest common extensions, to
the right and to the left, are found by one binary search over prefix hashes, vectorised over the pairs (those that
disagree within half a period on both sides are left out by two looks first); a pair whose extensions reach a whole
period lies in a run. Equal stretches found at several periods are one run, of the smallest.

Hashes can only overstate an extension, never miss one. Each run found is compared word by word within and at both
ends, and all is done again with other hashes where one fails, so results are exact.

Memory is that of a text's words and of ``PAIRS`` pairs at a time; the work of a text is n log n for usual texts and
n (log n) squared at most. Tasks take whole texts, without a shuffle.

Edge cases: a null, empty or blank text has no words, no runs and the empty text as its rest. Very long texts are read
whole. Of equally long runs the first one, then the one of the smaller period, is the longest. Repeated rows, and rows
with equal or null ids, give rows of their own. Empty tables give empty results. Extra columns, of whatever name,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let, rows_of, text_of, tidied, words_of

LEAST = 12
#: Pairs of one vectorised search.
PAIRS = 1 << 19
#: So many long runs of many periods are remembered while a text is searched; it saves work only.
WIDE = 16
PRIMES = (2_147_483_647, 2_147_483_629)


class _Hashes:
    """Prefix hashes of a sequence of word numbers by two primes; equal stretches have equal hashes."""

    def __init__(self, words: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        own = r.integers(1, min(PRIMES), (2, int(words.max()) + 1), np.uint64)
        self.parts = []
        for prime, values in zip(PRIMES, own):
            p = np.uint64(prime)
            base = np.uint64(r.integers(1 << 20, prime - 1))
            powers = np.ones(len(words) + 1, np.uint64)
            k, step = 1, base
            while k <= len(words):  # powers double in number each time
                powers[k : 2 * k] = powers[: len(powers[k : 2 * k])] * step % p
                k, step = 2 * k, step * step % p
            sums = np.zeros(len(words) + 1, np.uint64)
            # Terms are below 2**31, so sums of 2**33 words fit.
            np.cumsum(values[words] * powers[:-1] % p, out=sums[1:])
            self.parts.append((p, sums % p, powers))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and from b (further on) have the same hashes."""
        same = np.ones(len(a), bool)
        for p, sums, powers in self.parts:
            x = (sums[a + n] + p - sums[a]) * powers[b - a] % p
            same &= x == (sums[b + n] + p - sums[b]) % p
        return same


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """The largest n up to ``most`` with ``fits(pairs, n)``, for all pairs by one binary search; it holds for 0."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        ok = fits(open_, middle)
        low[open_[ok]] = middle[ok]
        high[open_[~ok]] = middle[~ok] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _grid(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) of the pairs whose words are equal, in blocks of about ``PAIRS`` pairs or one period."""
    n = len(words)
    p = 1
    while p <= n // 2:
        to, total = p, 0
        while to <= n // 2 and (total == 0 or total + (n - 1) // to <= PAIRS):
            # All periods of equal size class at once where they are many.
            step = max(1, min(n // 2 + 1 - to, (PAIRS - total) // max(1, (n - 1) // to)))
            total += step * ((n - 1) // to)
            to += step
        periods = np.arange(p, min(to, n // 2 + 1))
        counts = (n - 1) // periods  # points 0, p, ... below n - p
        period = np.repeat(periods, counts)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        same = words[at] == words[at + period]
        if same.any():
            yield period[same], at[same]
        p = to


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(words)
    if n < least:
        return np.empty((0, 3), np.int64)
    seed = 1
    while (found := _search(words, least, seed)) is None:
        seed += 1
    return found


def _search(words: np.ndarray, least: int, seed: int) -> np.ndarray | None:
    n, hashes, found, wide = len(words), None, [], []
    for p, i in _grid(words):
        for s, e, q in wide:  # pairs of a multiple of q within a run of period q find that run again
            new = (i < s) | (i + p >= e) | (p % q != 0)
            p, i = p[new], i[new]
        if not len(p):
            continue
        hashes = hashes or _Hashes(words, seed)
        # Of extensions that reach a period and ``least`` together, one has half of that.
        half = (np.maximum(p, least - p) + 1) // 2
        near = np.zeros(len(p), bool)
        fits = np.flatnonzero(i + p + half <= n)
        near[fits] = hashes.equal(i[fits], i[fits] + p[fits], half[fits])
        fits = np.flatnonzero(~near & (i >= half))
        near[fits] = hashes.equal(i[fits] - half[fits], i[fits] + p[fits] - half[fits], half[fits])
        p, i = p[near], i[near]
        if not len(p):
            continue
        right = _longest(lambda k, m: hashes.equal(i[k], i[k] + p[k], m), n - i - p)
        left = _longest(lambda k, m: hashes.equal(i[k] - m, i[k] + p[k] - m, m), i)
        whole = (left + right >= p) & (left + right + p >= least)
        if whole.any():
            own = np.unique(np.stack([i - left, i + p + right, p], 1)[whole], axis=0)
            found.append(own)
            own = own[np.unique(own[:, :2], axis=0, return_index=True)[1]]  # of one stretch the smallest period
            wide += own[own[:, 1] - own[:, 0] >= np.maximum(n // WIDE, 64 * own[:, 2])][: WIDE - len(wide)].tolist()
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    smallest = rows[first][np.cumsum(first) - 1, 2]
    if (rows[:, 2] % smallest).any():  # periods of one stretch of two periods' length are multiples of the smallest
        return None
    rows = rows[first]
    for s, e, p in rows.tolist():
        if not np.array_equal(words[s : e - p], words[s + p : e]) or (s and words[s - 1] == words[s - 1 + p]) or (e < n and words[e] == words[e - p]):
            return None
    return np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run has after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def of_text(text: str | None) -> tuple[int, np.ndarray, str]:
    """The number of words, the runs and the text without repeats, words joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = runs(numbers)
    if len(found):
        words = [words[k] for k in np.flatnonzero(kept(len(words), found))]
    return len(numbers), found, b" ".join(words).decode("utf-8", "surrogatepass")


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@tidied
def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        found = [of_text(t) for t in b.column(1).to_pylist()]
        own = [[dict(zip(("start", "length", "period"), r)) for r in rows.tolist()] for _, rows, _ in found]
        columns = [b.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(own, pa.list_(RUN)), pa.array([t for _, _, t in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def collapse(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (text)."""
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_collapse, schema)


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by a hash of the id, repeats its words from some place on.

    With h = crc32 of the id in decimal and g = h // 10, where h % 10 is 0 and a text has n words, each word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        turned = F.concat(F.slice(w, 1, a), let(F.slice(w, a + 1, p), lambda s: F.flatten(F.array_repeat(s, F.ceil((n - a) / p).cast("int")))))
        return F.when(n > 0, F.array_join(F.slice(turned, 1, n), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(text_of()), repeated)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of :func:`collapse` the number of runs, the longest run, and digests of all runs and of the collapsed text."""
    # Sorted by falling length, then start and period, the first is the longest.
    keyed = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    best = F.when(F.size("runs") > 0, F.array_min(keyed))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed", "n_words")
    return rows.select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
