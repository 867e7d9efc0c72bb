"""Vector search against a brute-force one, and on edge cases."""

import numpy as np
import pytest

from codeloom.operators import vectors


def table(spark, rows):
    return vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def nearest(rows, asked, k):
    x = {}
    for i, v in rows:
        x.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for q in asked:
        s = sorted((-round(float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), 6), i) for i, v in x.items())
        out += [(q, i, -c, r + 1) for r, (c, i) in enumerate(s[:k])]
    return out


def found(df):
    return sorted(((r["query_id"], r["vec_id"], r["similarity"], r["rank"]) for r in df.collect()), key=lambda x: (x[0], x[3]))


@pytest.fixture
def some():
    r = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(700, 20)))]
    return rows + [(700 + k, [1.0] + [0.0] * 19) for k in range(40)]


@pytest.mark.parametrize("block", [4096, 50])
def test_exact(spark, some, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    df = table(spark, some)
    assert found(vectors.exact(df, df.filter("id % 100 = 0"), 7)) == nearest(some, range(0, 740, 100), 7)


@pytest.mark.parametrize("block", [4096, 60])
def test_index(spark, block, monkeypatch):
    """Vectors in clusters, in several lists and blocks: nearly all neighbours are found, though few lists are probed."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LIST", 100)
    r = np.random.default_rng(9)
    centres = r.normal(size=(24, 30)) * 3
    rows = [(k, (centres[k % 24] + r.normal(size=30)).tolist()) for k in range(3000)]
    df = table(spark, rows).cache()
    asked = df.filter("id % 100 = 0")
    index = vectors.fit(df)
    assert len(index.centroids) == 30 and index.probes < 15
    built = vectors.build(df, index)
    assert built.count() == 3000 and built.select("list").distinct().count() > 20
    got = vectors.search(df, built, index, asked)
    want = vectors.exact(df, asked)
    assert got.count() == want.count() == 300
    assert vectors.recall(got, want).first()["recall"] >= 0.95
    assert len({(q, i) for q, i, _, _ in found(got)} & {(q, i) for q, i, _, _ in found(want)}) >= 285


def test_edges(spark, some):
    bad = [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] * 20), (904, [None] * 20), (905, [float("inf")] * 20)]
    df = table(spark, some + bad)
    assert df.count() == 740
    for way in (vectors.exact, vectors.neighbors):
        assert way(table(spark, []), df.limit(1)).count() == 0
        assert way(df, df.filter("id < 0")).count() == 0
        few = table(spark, some[:3])
        assert found(way(few, few.filter("id = 1"), 10)) == nearest(some[:3], [1], 10)
        # Copies of a vector: the smallest ids.
        copies = found(way(df, df.filter("id = 720"), 5))
        assert [i for _, i, _, _ in copies] == [700, 701, 702, 703, 704]
