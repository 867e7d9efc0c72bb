"""A byte-level convolutional network for document quality, in numpy.

Bytes are embedded; learned filters run over overlapping windows of ``3 * STEP`` bytes, ``STEP``
apart, over the whole document. Windows are max-pooled within overlapping chunks of ``2 * HALF``
windows; the largest value over the document and the mean over its chunks go through a small
dense layer into one probability.

The network is fitted on the driver, on at most ``PER_CLASS`` labelled documents of each label, of
at most ``LONGEST`` bytes (documented bounds); rows held out by the caller are never seen. Scoring
reads whole texts, in blocks, one scan without a shuffle. Inputs of a score are the text's bytes
only.

Edge cases: a null text counts as an empty one and is scored like any other; a very long one is scored
whole, in blocks. Null labels, labels other than 0 and 1 and those without a doc_id are dropped; of
conflicting ones the smaller counts. Rows with equal or null ids are scored each. Extra columns, of
whatever name, are ignored by :func:`score` and kept by :func:`keep`. Without labels of both classes there
is nothing to learn: all scores are the share of label 1 (0.5 without labels), and :func:`keep`
then rejects nothing. Repeated rows repeat. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import tidied

#: Most documents of each label in the fitting sample, and the weight of label 1 against label 0.
PER_CLASS = {0: 700, 1: 1400}
WEIGHT = 0.6
LONGEST = 16_384
THRESHOLD = 0.7
STEP, EMBED, FILTERS, HALF, HIDDEN = 4, 6, 16, 16, 12
UNIT = STEP * HALF
BLOCK = 1 << 17
ROWS = 256


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def padded(text: bytes) -> int:
    """Length after padding: the last window lies in the document and whole halves are filled."""
    return -(-(len(text) + 2 * STEP) // UNIT) * UNIT


class Network:
    """Weights: table (256, EMBED), conv (3, STEP * EMBED, FILTERS), bias, dense layers."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "table": r.normal(0, 0.5, (256, EMBED)).astype(f),
            "conv": r.normal(0, 0.15, (3, STEP * EMBED, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "w1": r.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f),
            "b1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, 0.3, HIDDEN).astype(f),
            "b2": np.zeros(1, f),
        }

    def windows(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter values of each window; the two windows that would leave a document are zero."""
        p = self.p
        x = p["table"][data].reshape(-1, STEP * EMBED)
        y = x @ p["conv"][0] + p["bias"]
        y[:-1] += x[1:] @ p["conv"][1]
        y[:-2] += x[2:] @ p["conv"][2]
        np.maximum(y, 0, out=y)
        last = ends // STEP
        y[last - 1] = 0
        y[last - 2] = 0
        return x, y

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; memory is bounded by ``BLOCK``, also for one very long text."""
        out = np.empty(len(texts), np.float64)
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= BLOCK):
                n += len(texts[to])
                to += 1
            out[at:to] = self._block(texts[at:to]) if n <= 2 * BLOCK else self._long(texts[at])
            at = to
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        data, ends = joined(texts)
        _, y = self.windows(data, ends)
        halves = y.reshape(-1, HALF, FILTERS).max(1)
        return self.combine(*pooled(halves, ends // UNIT))

    def _long(self, text: bytes) -> np.ndarray:
        """One text, in pieces that overlap by the two blocks which the last windows look into."""
        data = np.zeros(padded(text), np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        halves = []
        for k in range(0, len(data), BLOCK):
            part = data[k : k + BLOCK + 2 * STEP]
            n = min(BLOCK, len(data) - k)
            x = self.p["table"][part].reshape(-1, STEP * EMBED)
            y = x @ self.p["conv"][0] + self.p["bias"]
            y[:-1] += x[1:] @ self.p["conv"][1]
            y[:-2] += x[2:] @ self.p["conv"][2]
            np.maximum(y, 0, out=y)
            if k + n == len(data):
                y[n // STEP - 2 : n // STEP] = 0
            halves.append(y[: n // STEP].reshape(-1, HALF, FILTERS).max(1))
        halves = np.concatenate(halves)
        return self.combine(*pooled(halves, np.array([len(halves)])))

    def combine(self, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        p = self.p
        h = np.maximum(np.concatenate([largest, mean], 1) @ p["w1"] + p["b1"], 0)
        return 1 / (1 + np.exp(-(h @ p["w2"] + p["b2"][0]).astype(np.float64)))

    def step(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        p = self.p
        data, ends = joined(texts)
        x, y = self.windows(data, ends)
        cells = y.reshape(-1, HALF, FILTERS)
        arg = cells.argmax(1)
        halves = np.take_along_axis(cells, arg[:, None, :], 1)[:, 0]
        stops = ends // UNIT
        starts = np.concatenate([[0], stops[:-1]])
        largest, mean = pooled(halves, stops)
        features = np.concatenate([largest, mean], 1)
        h = np.maximum(features @ p["w1"] + p["b1"], 0)
        prob = 1 / (1 + np.exp(-(h @ p["w2"] + p["b2"][0])))
        g = ((prob - labels) * weights / weights.sum()).astype(np.float32)
        out = {"w2": h.T @ g, "b2": np.array([g.sum()], np.float32)}
        gh = np.outer(g, p["w2"]) * (h > 0)
        out |= {"w1": features.T @ gh, "b1": gh.sum(0)}
        gf = gh @ p["w1"].T
        at = np.zeros_like(halves)
        for i, (a, b) in enumerate(zip(starts, stops)):
            own = halves[a:b]
            k = own.argmax(0)
            at[a + k, np.arange(FILTERS)] += gf[i, :FILTERS]
            share = gf[i, FILTERS:] / max(1, b - a - 1)
            if b - a == 1:
                at[a] += share
            else:
                first = own[:-1] >= own[1:]
                at[a : b - 1] += first * share
                at[a + 1 : b] += ~first * share
        gy = np.zeros_like(y)
        np.put_along_axis(gy.reshape(-1, HALF, FILTERS), arg[:, None, :], at[:, None, :], 1)
        gy *= y > 0
        out["bias"] = gy.sum(0)
        out["conv"] = np.stack([x.T @ gy, x[1:].T @ gy[:-1], x[2:].T @ gy[:-2]])
        gx = gy @ p["conv"][0].T
        gx[1:] += gy[:-1] @ p["conv"][1].T
        gx[2:] += gy[:-2] @ p["conv"][2].T
        gx = gx.reshape(-1, EMBED)
        out["table"] = np.stack([np.bincount(data, gx[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded texts one after the other, and their ends."""
    sizes = np.array([padded(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.zeros(ends[-1], np.uint8)
    for t, e, n in zip(texts, ends, sizes):
        data[e - n : e - n + len(t)] = np.frombuffer(t, np.uint8)
    return data, ends


def pooled(halves: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the largest value, and the mean over its chunks of two neighbouring halves."""
    starts = np.concatenate([[0], stops[:-1]])
    largest = np.maximum.reduceat(halves, starts, axis=0)
    chunks = np.maximum(halves, np.concatenate([halves[1:], halves[-1:]]))
    sizes = stops - starts
    chunks[stops - 1] = np.where((sizes == 1)[:, None], halves[stops - 1], 0)
    return largest, np.add.reduceat(chunks, starts, axis=0) / np.maximum(1, sizes - 1)[:, None].astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on batches drawn in a fixed random order."""
    net, r = Network(seed), np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    weights = np.where(labels == 1, WEIGHT / max(1, (labels == 1).sum()), (1 - WEIGHT) / max(1, (labels == 0).sum())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            t += 1
            for name, g in net.step([texts[i] for i in own], labels[own], weights[own]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                pace = rate * (1 - t / (total + 1))
                net.p[name] -= (pace * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS, longest: int = LONGEST) -> Network | float:
    """A network, or the share of label 1 where there is nothing to learn.

    The sample is the labelled rows with the smallest hashes of doc_id, ``per_class`` of each
    label at most: a distributed top-k, so its size is bounded at every input size. Of texts that share
    an id the smallest is read.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
    )
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[k]) for k in (0, 1)]
    ids = [tuple(r) for p in picked for r in p.collect()]
    if len({y for _, y in ids}) < 2:
        return ids[0][1] * 1.0 if ids else 0.5
    sample = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, label int"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= longest).join(sample, "doc_id")
    # One text for each id of the sample, so what comes to the driver is bounded however often an id repeats.
    rows = sorted(tuple(r) for r in rows.groupBy("doc_id").agg(F.min("text"), F.any_value("label")).collect())
    if len({y for *_, y in rows}) < 2:
        return float(np.mean([y for *_, y in rows])) if rows else 0.5
    return fit([t.encode("utf-8", "surrogatepass") for _, t, _ in rows], np.array([y for *_, y in rows]))


def _scores(net: Network | float, texts: pa.Array) -> np.ndarray:
    if isinstance(net, float):
        return np.full(len(texts), net)
    parts = [np.empty(0)]
    for k in range(0, len(texts), ROWS):
        own = texts.slice(k, ROWS).to_pylist()
        parts.append(net.scores([(t or "").encode("utf-8", "surrogatepass") for t in own]))
    return np.round(np.concatenate(parts), 6)


@tidied
def _score(batches: Iterator[pa.RecordBatch], net: Network | float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(net, b.column(1)), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, net=net), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@tidied
def _keep(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(_scores(net, b.column("text")) >= THRESHOLD))


def keep(docs: DataFrame, net: Network | float) -> DataFrame:
    """The rows that the network accepts, with all their columns."""
    return docs if isinstance(net, float) else docs.mapInArrow(partial(_keep, net=net), docs.schema)
