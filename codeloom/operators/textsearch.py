"""Ranked text search: an inverted index with block maxima, and a top-k that skips blocks.

Documents are dealt into blocks of about ``BLOCK`` by a hash. The index holds a row for each term and block: the block's postings of
the term, and the highest score that the term gives any of them. A search adds the maxima of its terms, block by
block, without reading postings; scores the ``FIRST`` blocks of the highest sums; and of the others scores only those whose sum
reaches the k-th score found. The result is that of scoring all.

The index takes one shuffle, of the texts by block: a block's postings are made where its texts meet, and stored in order of terms
as they lie, so that searches read the pages of their terms only.

Terms are runs of letters a-z and digits, A-Z lower-cased. Scores are BM25, rounded to six decimals, equal ones in order
of id.

Edge cases: null and empty texts count as documents without terms. Terms are counted in whole texts. A search without words, for words
that no text has, or in an empty table finds nothing; a word given twice counts once. Repeated ids are documents of their own only
where their texts differ; null ids are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime.scratch import Stored

K1, B = 1.2, 0.75
BLOCK, FIRST = 1024, 8
TERM = re.compile(rb"[a-z0-9]+")
POSTINGS = "term string, block long, n long, most double, postings array<struct<doc_id:bigint,copy:bigint,part:double>>"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pc.fill_null(pc.count_substring_regex(b.column(2), "[A-Za-z0-9]+"), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "copy", "length"])


def _block(block: int, docs: list[tuple[int, int, int]], found: list[Counter], average: float) -> pa.RecordBatch:
    """The index rows of a block: ``docs`` are (doc_id, copy, length), ``found`` the terms of each and how often it has them."""
    ids, copies, lengths = np.array(docs, np.int64).T
    terms = pa.array(list(chain.from_iterable(found)), pa.binary()).dictionary_encode()
    tf = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, len(terms))
    at = np.repeat(np.arange(len(docs)), [len(c) for c in found])
    codes = terms.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    # The part of the score that the term's rarity doesn't change.
    part = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / average)))[order]
    n = np.bincount(codes)
    starts = np.cumsum(n) - n
    postings = pa.StructArray.from_arrays([pa.array(ids[at[order]]), pa.array(copies[at[order]]), pa.array(part)], ["doc_id", "copy", "part"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(part)], pa.int32()), postings)
    columns = [terms.dictionary.cast(pa.string()), pa.array(np.full(len(n), block)), pa.array(n), pa.array(np.maximum.reduceat(part, starts)), lists]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "most", "postings"])


def _indexed(batches: Iterator[pa.RecordBatch], average: float) -> Iterator[pa.RecordBatch]:
    """The index rows of texts (block, doc_id, copy, text) sorted by these; a row like the one before is no document of its own."""
    now, docs, found = None, [], []
    for b in batches:
        texts = b.column(3).cast(pa.binary())
        for block, i, copy, text in zip(*(b.column(k).to_pylist() for k in range(3)), texts):
            if block != now:
                if any(found):
                    yield _block(now, docs, found, average)
                now, docs, found = block, [], []
            if docs and docs[-1][:2] == (i, copy):
                continue
            words = TERM.findall((text.as_py() or b"").lower())
            docs.append((i, copy, len(words)))
            found.append(Counter(words))
    if any(found):
        yield _block(now, docs, found, average)


def lists(own: DataFrame, blocks: int, average: float) -> DataFrame:
    """The rows of the index of ``own`` (doc_id, copy, text); ``average`` is the mean number of terms."""
    at = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)).cast("long").alias("block")
    dealt = own.select(at, "doc_id", "copy", "text").repartition("block").sortWithinPartitions("block", "doc_id", "copy")
    return dealt.mapInArrow(partial(_indexed, average=average), POSTINGS)


class Index:
    """The stored index of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, block: int = BLOCK):
        own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
        lengths = own.mapInArrow(_lengths, "doc_id long, copy long, length long").distinct()
        counted = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        self.documents, total = counted["n"], counted["total"]
        self.blocks = max(1, -(-self.documents // block))
        average = max(total / self.documents, 1e-9) if self.documents else 1.0
        self._stored = Stored(lists(own, self.blocks, average).sortWithinPartitions("term", "block"))
        self.postings = self._stored.df

    def free(self) -> None:
        self._stored.free()

    def _weighted(self, words: list[str]) -> DataFrame:
        """The rows of the words, with the weight of each; the filter reaches the scan."""
        rows = self.postings.filter(F.col("term").isin(sorted({w.lower() for w in words})))
        df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.log(1 + (F.lit(self.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return rows.join(F.broadcast(df.select("term", weight.alias("weight"))), "term")  # a row for each word

    def bounds(self, words: list[str]) -> DataFrame:
        """(block, most): what no document of the block scores above."""
        return self._weighted(words).groupBy("block").agg(F.sum(F.col("most") * F.col("weight")).alias("most"))

    def _scored(self, words: list[str], blocks: DataFrame | None) -> DataFrame:
        rows = self._weighted(words)
        if blocks is not None:
            rows = rows.join(blocks, "block", "left_semi")
        each = rows.select("block", "weight", F.explode("postings").alias("p")).select("p.doc_id", "p.copy", (F.col("p.part") * F.col("weight")).alias("s"))
        return each.groupBy("doc_id", "copy").agg(F.round(F.sum("s"), 6).alias("score")).select("doc_id", "score")

    def search(self, words: list[str], k: int = 20) -> tuple[DataFrame, DataFrame]:
        """The ``k`` best documents (doc_id, score), and one row: blocks with a word, and of these the blocks scored and skipped."""
        spark = self.postings.sparkSession
        if not words:
            none = spark.createDataFrame([], "doc_id long, score double")
            return none, spark.createDataFrame([(0, 0, 0)], "blocks long, scored long, skipped long")
        bounds = self.bounds(words)
        top = bounds.orderBy(F.desc("most"), "block").limit(FIRST)
        first = self._scored(words, top).orderBy(F.desc("score"), "doc_id").limit(k).collect()
        least = first[-1]["score"] if len(first) == k else 0.0
        # Half a unit of the last decimal, as scores are rounded.
        able = bounds.filter(F.col("most") >= least - 1e-6)
        found = self._scored(words, able.select("block")).orderBy(F.desc("score"), "doc_id").limit(k)
        counted = bounds.agg(F.count("*").alias("blocks"), F.count_if(F.col("most") >= least - 1e-6).alias("scored"))
        return found, counted.select("blocks", "scored", (F.col("blocks") - F.col("scored")).alias("skipped"))
