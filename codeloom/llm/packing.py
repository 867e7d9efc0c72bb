"""Best-fit-decreasing packing of documents into sequences of fixed length.

A longer document is cut into pieces of ``CAPACITY`` tokens, the first piece holding the rest, so
no cut makes more than one short piece. All pieces of all documents are then packed by best-fit
decreasing as one problem, though no task holds them: lengths are integers of at most
``CAPACITY``, so the exact result of best-fit decreasing depends on the histogram of lengths only,
and that has at most ``CAPACITY`` rows at any input size. The driver replays the algorithm on the
histogram with a segment tree over remaining capacities: the tightest open bins that hold a length
are found in logarithmic time, and all bins of one capacity are filled at once, as one run. The
runs are a small table (its rows depend on the capacity, not on the data); each piece finds its
bin by its rank among the pieces of its length.

Ranks need no sort: as pieces are made, each gets its place among the pieces of its length in its task,
which the stored table fixes, and the counts of the tasks before are added from a table of one row for
each task and length. That table is broadcast up to ``BROADCAST_ROWS`` rows (counted), so pieces and
their ids aren't shuffled; beyond that they are joined by task and length, keys that no document's id or
length can make larger than a task. There are no ties that a repeated task could break otherwise.

Edge cases: a null text is empty; an empty document has one token (the end mark). Very long texts are
encoded in blocks and give many pieces. Null and repeated ids and repeated rows are packed each. Empty
tables give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm import bpe, pretokens
from codeloom.llm.common import Stored, cut, rows_of, tidied

CAPACITY = 1024
END = 2
BROADCAST_ROWS = 1_000_000
SPECIAL = "<|endoftext|>"
RUN_SCHEMA = "length long, lo long, hi long, first_bin long, per_bin long, room long"


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, generation: int | None = None) -> pretokens.Encoder:
    """The ids of the tokenizers library for a byte-level BPE file.

    Where the ids of merged tokens are in the order of their merges, as in the public file, the
    ids are ranks, and the merges run in a rank-based encoder, which gives the same ids at a fifth
    of the time. Texts with the special token, and other files, go through the library itself.
    """
    @lru_cache(maxsize=1)
    def library():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def whole(text: str) -> list[int]:
        return library().encode(text, add_special_tokens=False).ids

    with open(vocabulary, encoding="utf-8") as f:
        bpe_model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in bpe_model["merges"]]
    made = [bpe_model["vocab"].get("".join(m)) for m in merges]
    if made != sorted(set(made), key=lambda k: (k is None, k)):
        return pretokens.Encoder(whole, generation=generation)
    import public_tokenizers
    import tiktoken

    value = {c: b for b, c in enumerate(bpe.byte_characters())}
    ranks = {bytes(value[c] for c in t): k for t, k in bpe_model["vocab"].items() if t != SPECIAL}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return pretokens.Encoder(plain.encode_ordinary, SPECIAL, whole, generation)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; only the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


@tidied
def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, with_ids: bool, generation: int | None = None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(vocabulary, generation)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int32())] * with_ids
    task, places = TaskContext.get().partitionId(), [0] * (capacity + 1)
    for b in rows_of(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.append(encoder.ids(text or ""), np.uint32(END)).astype("<u4")
            for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                own = ids[s : s + n]
                rows.append((doc_id, k, s, n, zlib.crc32(own.tobytes()), task, places[n]) + ((own.astype(np.int32),) if with_ids else ()))
                places[n] += 1
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, generation: int | None = None) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, task, place (and ids).

    ``place`` counts the pieces of a length in a task; both are fixed once the pieces are stored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, vocabulary=vocabulary, capacity=capacity, with_ids=with_ids, generation=generation), schema)


class Capacities:
    """A segment tree over remaining capacities: how many runs of bins have each capacity open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, room: int, run: tuple[int, int]) -> None:
        """Bins from run[0] on, run[1] of them."""
        self.runs.setdefault(room, []).append(run)
        self._change(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._change(room, -1)
        return self.runs[room].pop()

    def _change(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest open capacity of at least ``length``, in logarithmic time."""
        k = length + self.size
        if self.count[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``histogram`` (length -> pieces), as runs.

    A run (length, lo, hi, first_bin, per_bin, room) puts the pieces of ranks lo..hi-1 of that
    length into bins first_bin on, per_bin in each, where each bin had ``room`` left before.
    """
    tree, out, bins = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            first, n = (bins, None) if room is None else tree.take(room)
            room = capacity if room is None else room
            per = room // length
            whole = left // per if n is None else min(n, left // per)
            if whole:
                out.append((length, rank, rank + whole * per, first, per, room))
                rank, left = rank + whole * per, left - whole * per
                if room - per * length:
                    tree.add(room - per * length, (first, whole))
            used = whole
            if left and (n is None or whole < n):
                out.append((length, rank, rank + left, first + whole, left, room))
                if room - left * length:
                    tree.add(room - left * length, (first + whole, 1))
                used, left = whole + 1, 0
            if n is None:
                bins += used
            elif used < n:
                tree.add(room, (first + used, n - used))
    return out


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (stored pieces) with sequence_id and offset instead of task and place."""
    spark = found.sparkSession
    counts = cut(found.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # At most one row for each length; the runs that follow from it don't grow with the input.
    runs = F.broadcast(spark.createDataFrame(plan(histogram, capacity), RUN_SCHEMA).withColumnRenamed("length", "run_length"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    right = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    ranked = found.join(right, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    hit = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(runs, (F.col("length") == F.col("run_length")) & hit)
    k = F.col("rank") - F.col("lo")
    return out.select(
        *[c for c in found.columns if c not in ("task", "place")],
        (F.col("first_bin") + F.floor(k / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.lit(capacity) - F.col("room") + k % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, generation: int | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.

    ``generation`` bounds the encoder's cache of parts on each Python worker.
    """
    return placed(Stored(pieces(docs, vocabulary, capacity, with_ids, generation)).df, capacity)
