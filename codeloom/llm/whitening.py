"""Whitening of embeddings by a covariance in two passes.

An entry c becomes the whole number x = floor(1024 c) + 100000. The first pass sums the numbers of rows and of x
exactly, so the mean is the same however rows are dealt. The second pass centres each row on the exact numerator
n x - S, divides by n, and sums outer products by matrix products of blocks; partitions leave one matrix each,
which ``treeAggregate`` merges level by level, so the driver receives one matrix of the embedding's size (dimension
squared) and no rows. LAPACK's symmetric solver gives the components; their projection, of at most ``COMPONENTS``
rows, is broadcast. A third pass measures how far the covariance of the projected rows is from the identity.

Edge cases: a vector that is null, or has a null or non-finite entry, is left out. Where lengths differ, vectors of the
commonest length stay (of equally common ones the longest). Components whose eigenvalue is zero to double precision, as
where there are fewer rows than dimensions, one row, or equal rows, have no scale and are left out, so such inputs give
fewer rows or none. Entries beyond ``LARGEST`` count as ``LARGEST``, which keeps all sums exact. A deviation that no
long can hold is null. Repeated rows, and rows with equal or null ids, each count and give rows of their own. Empty
tables and empty vectors give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import tidied

SCALE, SHIFT = 1024, 100_000
#: Entries beyond it count as this: numbers x stay below 2**37, their sums over 2**26 rows below 2**63.
LARGEST = float(1 << 26)
COMPONENTS = 8
#: Rows of one matrix product, and levels of the merge.
BLOCK, DEPTH = 4096, 3
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, sums, and the components (rows of ``axes``) with their eigenvalues, largest first."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        """What a centred row is multiplied with: components by columns, over the roots of their eigenvalues."""
        return (self.axes / np.sqrt(self.eigenvalues)[:, None]).T

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def integers(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers of entries, as longs."""
    return np.floor(SCALE * np.clip(vectors.astype(np.float64), -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def numerators(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exactly: longs where they fit, else Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) * 2 < MOST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return numerators(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n x - S) squared of each row, exactly; None where no long holds it."""
    own = numerators(x, n, sums)
    most = int(np.abs(own).max(initial=0))
    if most * most * max(1, own.shape[1]) <= MOST:
        return (own.astype(np.int64) ** 2).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in own]
    return [v if v <= MOST else None for v in found]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices, with their vectors as whole numbers, a row each."""
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            part = b.slice(k, BLOCK)
            yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


@tidied
def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * dim
    for _, x in _blocks(batches, 0, dim):
        n += len(x)
        # Sums of a block are far below 2**63; Python's integers hold the rest.
        total = [a + int(b) for a, b in zip(total, x.sum(0))]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["n", "sums"])


@tidied
def _products(batches: Iterator[pa.RecordBatch], dim: int, of: Callable[[np.ndarray], np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """One row a task: the sum of outer products of what ``of`` makes of each row."""
    out = np.zeros((width, width))
    for _, x in _blocks(batches, 0, dim):
        y = of(x)
        out += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])


def _projected(x: np.ndarray, fit: Whitening) -> np.ndarray:
    return centred(x, fit.n, fit.sums) @ fit.projection


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` without those that are null or have null or non-finite entries, or another length than most."""
    v = F.col(f"`{vector}`")
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.filter(v.isNotNull() & (F.size(v) > 0)).filter(~wrong)
    length = F.size(v)
    common = good.groupBy(length.alias("__size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("__size")).limit(1).collect()
    return good.filter(length == (common[0]["__size"] if common else 0))


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of the matrices in ``rows`` (m), merged as a tree on the executors."""
    zero = np.zeros((width, width))
    return rows.rdd.treeAggregate(zero, lambda a, r: a + np.frombuffer(r["m"]).reshape(a.shape), np.add, DEPTH)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (those of :func:`usable`); None where there are none."""
    own = vectors.select(F.col(f"`{vector}`").alias("v"))
    first = own.first()
    if first is None:
        return None
    dim = len(first["v"])
    parts = own.mapInArrow(partial(_sums, dim=dim), "n long, sums array<string>").rdd
    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])
    n, sums = parts.treeAggregate((0, [0] * dim), lambda a, r: add(a, (r["n"], [int(s) for s in r["sums"]])), add, DEPTH)
    of = partial(centred, n=n, sums=tuple(sums))
    v = _summed(own.mapInArrow(partial(_products, dim=dim, of=of, width=dim), "m binary"), dim) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * dim * np.finfo(float).eps]
    axes = axes.T[order]
    # Of the two signs the one whose largest entry is positive.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None] if len(axes) else axes
    return Whitening(n, tuple(sums), axes, values[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, by another pass."""
    k = len(fitted.axes)
    if not k:
        return 0.0
    rows = vectors.select(F.col(f"`{vector}`").alias("v")).mapInArrow(partial(_products, dim=len(fitted.sums), of=partial(_projected, fit=fitted), width=k), "m binary")
    return float(np.abs(_summed(rows, k) / fitted.n - np.eye(k)).max())


@tidied
def _apply(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    fitted: Whitening = held.value
    for b, x in _blocks(batches, 1, len(fitted.sums)):
        y = _projected(x, fitted)
        white = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if y.shape[1] else np.zeros(len(y) + 1, np.int32), y.ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()), white], ["vec_id", "deviation", "whitened"])


def apply(vectors: DataFrame, fitted: Whitening, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector its id, its deviation, and ``whitened``, an entry for each component."""
    held = vectors.sparkSession.sparkContext.broadcast(fitted)
    rows = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    return rows.mapInArrow(partial(_apply, held=held), "vec_id long, deviation long, whitened array<double>")


def whitened(vectors: DataFrame) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    own = usable(vectors)
    fitted = fit(own)
    if fitted is None or not len(fitted.axes):
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(own, fitted)
    shares = F.array(*[F.lit(float(x)) for x in fitted.explained])
    rows = apply(own, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
