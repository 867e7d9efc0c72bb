"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime.scratch import Stored, cut

__all__ = ["SPACE", "Stored", "cut", "let", "prefix_sums", "rows_of", "table", "text_of", "tidied", "words_of"]

#: The separators of words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(f: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back to the system at its end.

    Python workers live on for other tasks and stages; what one has freed would else count against its executor.
    """

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **given) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args, **given)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices (views), so that few texts at a time are Python objects."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda an outer expression is computed anew for each element; bound as the only
    element of an array it is computed once a row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ``SPACE`` runs, as an array without empty strings.

    A split at one plain character needs no regular expression, so the other separators become
    spaces first.
    """
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def prefix_sums(lengths: Column) -> Column:
    """Sums of the elements before each element, in about n to the power 1.5 steps.

    The built-in functions have no scan. A fold that appends to an array copies it each time, so
    the fold runs over blocks of 64 and each block adds its own few elements.
    """
    return let(lengths, _prefix_sums)


def _prefix_sums(lengths: Column) -> Column:
    n = F.size(lengths)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int"))).otherwise(F.array().cast("array<int>"))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def scan(sums: Column) -> Column:
        before = F.aggregate(
            sums,
            F.array(F.lit(0).cast("long")),
            lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)),
        )
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return let(
            before,
            lambda b: F.transform(
                at,
                lambda i: F.get(b, F.floor(i / 64).cast("int"))
                + total(F.slice(lengths, i - i % 64 + 1, i % 64)),
            ),
        )

    return let(F.transform(blocks, lambda b: total(F.slice(lengths, b * 64 + 1, F.lit(64)))), scan)
