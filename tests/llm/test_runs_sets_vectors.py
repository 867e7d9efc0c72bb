"""Periodic runs, MinHash links and whitening against brute force, and on edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import components, minhash, near_sets, periodic_runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t", "a", "a b", "same words here", "same words here", "é ß 日本語 😀", "x" * 70_000, "word " * 30_000, "a\x0bb\x0cc\x1cd " * 5]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 11 periodic runs


def runs_by_definition(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("pairs", [1 << 19, 7])
def test_runs(pairs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    r = random.Random(11)
    for _ in range(400):
        n, k = r.randrange(100), r.choice([1, 2, 3, 40])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randrange(3) if n else 0):
            a = r.randrange(n)
            p = 1 + (n - a) // (3 + r.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert [tuple(x) for x in periodic_runs.runs(np.array(w, np.int64)).tolist()] == runs_by_definition(w)


def test_runs_where_hashes_collide(monkeypatch):
    """Hashes that take any stretches for equal: what they overstate isn't believed, other hashes are."""
    real, made = periodic_runs._Hashes, []

    class Weak(real):
        def __init__(self, words, seed):
            made.append(seed)
            super().__init__(words, seed)

        def equal(self, a, b, n):
            return np.ones(len(a), bool) if made[-1] < 3 else super().equal(a, b, n)

    monkeypatch.setattr(periodic_runs, "_Hashes", Weak)
    w = [1, 2, 3] * 6 + [1, 4, 5, 6, 7] + [8, 9] * 7
    assert [tuple(x) for x in periodic_runs.runs(np.array(w)).tolist()] == runs_by_definition(w)
    assert made == [1, 2, 3]


def test_long_repetitive_texts():
    w = np.zeros(300_000, np.int64)
    assert periodic_runs.runs(w).tolist() == [[0, 300_000, 1]]
    w[1::2] = 1
    w[250_000:] = np.arange(50_000)
    assert periodic_runs.runs(w)[0].tolist() == [0, 250_002, 2]  # 0, 1 go on as the first two of the rest


def collapsed_by_definition(w):
    gone = {k for s, n, p in runs_by_definition(w) for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_op11_columns(frame):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(80)] + [t for t in EDGE if len(t or "") < 1000]
    docs = frame(texts + [(None, "a b " * 9)])
    got = {(x["doc_id"], x["collapsed_sha256"]): x for x in periodic_runs.digests(periodic_runs.collapse(periodic_runs.with_planted(docs))).collect()}
    assert len(got) == len(texts) + 1
    for k, t in [*enumerate(texts), (None, "a b " * 9)]:
        w = WORD.findall(t or "")
        h = 1 if k is None else zlib.crc32(str(k).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_definition(w)
        x = got[k, hashlib.sha256(collapsed_by_definition(w).encode()).hexdigest()]
        s, m, p = min(runs, key=lambda u: (-u[1], u[0], u[2])) if runs else (None,) * 3
        want = (len(runs), s, m, p, 1000 * m // p if runs else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), n)
        assert (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"], x["runs_sha256"], x["n_words"]) == want


def test_collapse_edges(frame):
    got = {x["doc_id"]: x for x in periodic_runs.collapse(frame(EDGE)).collect()}
    assert [got[k]["n_words"] for k in range(5)] == [0, 0, 0, 1, 2] and got[0]["collapsed"] == ""
    assert got[9]["collapsed"] == "word" and [tuple(x) for x in got[9]["runs"]] == [(0, 30_000, 1)]
    assert got[10]["collapsed"] == "a b c\x1cd" and [tuple(x) for x in got[10]["runs"]] == [(0, 15, 3)]
    assert periodic_runs.digests(periodic_runs.collapse(periodic_runs.with_planted(frame([])))).collect() == []


# 12 minhash


def set_of(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def components_by_definition(texts):
    sets, at = [set_of(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if at[i] != at[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    return sets, at


def near_texts(seed=5):
    r = random.Random(seed)
    texts = []
    for n in (20, 60, 150, 300):
        for _ in range(6):
            w = [f"w{r.randrange(900)}" for _ in range(n)]
            texts.append(" ".join(w))
            for edits in (1, n // 40, n // 25, n // 18, n // 12, n // 6):
                new = list(w)
                for k in r.sample(range(n), edits):
                    new[k] = f"e{r.randrange(50)}"
                texts.append(" ".join(new).replace("w", r.choice("wW")))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("light", "few"), [(10_000, 250_000), (2, 0)])
def test_op12_by_brute_force(frame, light, few, monkeypatch):
    monkeypatch.setattr(minhash, "LIGHT", light)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", few)
    monkeypatch.setattr(near_sets, "BROADCAST_ROWS", few)
    texts = near_texts() + EDGE
    sets, at = components_by_definition(texts)
    got = {x["doc_id"]: x for x in minhash.components(frame(texts)).collect()}
    assert {k: (x["n_shingles"], x["component_id"], x["kept"]) for k, x in got.items()} == {k: (len(s), c, c == k) for k, (s, c) in enumerate(zip(sets, at))}
    assert len(set(at)) < len(at) - 40


def test_op12_null_and_repeated_ids(frame):
    t, u = ("w1 w2 w3 w4 w5 w6", "other words that are in no other text")
    docs = frame([(None, t), (4, t), (3, t.upper()), (3, u), (None, u.replace("no", "one")), (None, None), (8, " ")])
    got = rows_of(minhash.components(docs).select("doc_id", "component_id", "kept"))
    assert got == sorted([(None, 3, False), (4, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (8, 8, True)], key=str)
    assert minhash.components(frame([])).collect() == []


def test_tables_are_pairs_of_half_keys(spark):
    """Candidates are exactly the members of tables with their smallest, however rows are dealt."""
    r = np.random.default_rng(3)
    sets = {k: np.unique(r.choice(60, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(-60, 60)}
    keys = {k: minhash.half_keys(s) for k, s in sets.items()}
    tables = {}
    for k, (a, b) in sorted(keys.items()):
        for i, x in enumerate(a.tolist()):
            for j, y in enumerate(b.tolist()):
                tables.setdefault((i, x, j, y), []).append(k)
    want = {(k, m[0]) for m in tables.values() for k in m[1:]}
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in keys.items()]
    df = spark.createDataFrame(rows, "own long, first array<long>, second array<int>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        met, fellows = minhash.candidates(df)
        assert set(rows_of(met)) == want and want
        shared = {p: len([1 for m in tables.values() if set(p) <= set(m)]) for p in {tuple(sorted(r[:2])) for r in rows_of(fellows)}}
        assert shared and min(shared.values()) > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("light", [10_000, 2])
def test_tables_that_share_members_have_one_pivot(spark, light, monkeypatch):
    """Near copies have few pivots, at most one a half key; texts that share a table have one in common, and groups don't run into others."""
    monkeypatch.setattr(minhash, "LIGHT", light)
    r = np.random.default_rng(8)
    words, other = r.integers(0, 1 << 62, (2, 300)).astype(np.uint64)
    sets = {k: np.unique(np.r_[r.choice(words if k < 60 else other, 280, False), r.integers(0, 1 << 62, 20).astype(np.uint64)]) for k in range(80)}
    keys = {k: minhash.half_keys(s) for k, s in sets.items()}
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in keys.items()], "own long, first array<long>, second array<int>").repartition(5)
    single, grouped = (rows_of(minhash.candidates(df, g)[0]) for g in (False, True))
    tables = {}
    for k, (a, b) in keys.items():
        for i, x in enumerate(a.tolist()):
            for j, y in enumerate(b.tolist()):
                tables.setdefault((i, x, j, y), []).append(k)
    pivots = {k: {k} | {q for p, q in grouped if p == k} for k in sets}
    assert all(pivots[m[0]] & pivots[k] for m in tables.values() for k in m[1:])
    assert all((p < 60) == (q < 60) and q < p for p, q in grouped)
    most = max(sum(p == k for p, _ in grouped) for k in sets)
    assert most <= minhash.HALVES and len(grouped) < 0.5 * len(single)


def test_recall_of_tables():
    """Of pairs at similarity 0.8 (their share of equal half keys is that of the formula) hardly any shares no table."""
    r = np.random.default_rng(8)
    missed = 0
    for _ in range(300):
        s = r.integers(0, 1 << 63, 90).astype(np.uint64)
        (a, b), (c, d) = minhash.half_keys(np.unique(s[:80])), minhash.half_keys(np.unique(np.r_[s[10:80], s[80:]]))
        missed += not ((a == c).any() and (b == d).any())
    assert missed <= 2  # similarity 70 / 90: 2 * (1 - 0.47) ** 16 each


# 13 whitening


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, component string, n int")


def test_op13_by_definition(spark):
    r = np.random.default_rng(2)
    own = (r.normal(size=(700, 12)) @ r.normal(size=(12, 12))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(own)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("-inf")] + [0.0] * 11), (904, [1.0] * 5), (905, []), (3, own[4].tolist()), (None, own[4].tolist())]
    own = np.concatenate([own, own[4:5], own[4:5]])
    x = np.floor(1024 * own.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v.T[::-1]
    got = whitening.whitened(vectors(spark, rows).repartition(7)).collect()
    assert len(got) == 8 * n
    for c in range(8):
        part = sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["deviation"]))
        ids = [(k is None, k, int(((n * x[i] - s) ** 2).sum()), i) for i, k in enumerate([*range(700), 3, None])]
        order = sorted(ids, key=lambda t: (t[0], t[1] if t[1] is not None else 0, t[2]))
        assert [r["deviation"] for r in part] == [t[2] for t in order]
        want = np.array([y[t[3]] @ v[c] / math.sqrt(e[c]) for t in order])
        found = np.array([r["whitened"] for r in part])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-9
        assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and r["n"] == n and r["identity_error"] < 1e-9 for r in part)


def test_op13_without_scale(spark):
    """Components of no variance are left out; one row, equal rows and no rows give none."""
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    flat = whitening.whitened(vectors(spark, [(k, [k / 8, 2.0, k / 4]) for k in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and abs(flat[0]["explained"] - 1) < 1e-9
    assert whitening.whitened(vectors(spark, [(1, [1.0] * 3), (2, [2.0] * 2), (3, [3.0] * 3)])).filter("vec_id = 2").count() == 0


def test_op13_large_entries(spark):
    """Entries that no long could hold count as the largest; deviations stay exact or are null."""
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])]
    got = {r["vec_id"]: r for r in whitening.whitened(vectors(spark, rows)).filter("component = 1").collect()}
    x = np.array([[int(min(max(1024 * c, -1024 * whitening.LARGEST), 1024 * whitening.LARGEST)) + 100_000 for c in v] for _, v in rows], object)
    want = [sum((3 * a - b) ** 2 for a, b in zip(v, x.sum(0))) for v in x]
    assert [got[k]["deviation"] for k in (1, 2, 3)] == [d if d < 1 << 63 else None for d in want]
    assert whitening.deviations(np.array([[1 << 30, 0]]), 1 << 10, (0, 0)) == [None]
    assert whitening.deviations(np.array([[1 << 20, 3]]), 1 << 10, (5, 0)) == [((1 << 30) - 5) ** 2 + (3 << 10) ** 2]
