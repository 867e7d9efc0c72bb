"""The queries with SQL against DuckDB; the pipeline against its stages' definitions."""

import collections
import math
import os
import re

import pyarrow as pa
import pytest
import regex
import xxhash

duckdb = pytest.importorskip("duckdb")
import corpus_pipeline  # noqa: E402
from codeloom.llm import queries, simhash  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    rows = sorted(map(str, (tuple(r[c] for c in order) for r in df.collect())))
    assert rows == sorted(map(str, want.select(", ".join(order)).fetchall()))


def test_pipeline(spark):
    docs = before = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, DATA).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        if name != "pii":
            assert docs.exceptAll(before).isEmpty()
        before = docs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(re.search(r"[a-z]@[a-z0-9-]+\.[a-z]", t) for t in texts.values())
    prints = [simhash.fingerprint(t) for t in texts.values()]
    near = sum((a ^ b).bit_count() <= 3 for k, a in enumerate(prints) for b in prints[:k])
    assert near <= 2  # masking personal data may bring two texts closer
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(texts)


def shingles_of(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def print_of(text):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles_of(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


MARKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0


def marked(text, terms):
    """A text with its matches and terms covered, from the patterns as they are written."""
    found = []
    for n, (kind, pattern) in enumerate(MARKS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")[:4]) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            found += [(m.start(), n, m.end(), f"[{kind}]")] if ok else []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        bits = sum(n * math.log2(len(m[0]) / n) for n in collections.Counter(m[0]).values())
        if len(m[0]) >= 16 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and bits >= 48:
            found.append((m.start(), 4, m.end(), "[secret]"))
    for m in regex.finditer(r"\p{L}+", text):
        if m[0].lower() in terms:
            found.append((m.start(), 5, m.end(), "" if terms[m[0].lower()] >= 0.8 else "[term]"))
    out, at = "", 0
    for a, _, b, mark in sorted(found):
        out += text[at : max(at, a)] + (mark if a >= at else "")
        at = max(at, b)
    return out + text[at:]


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input: rules by SQL, groups by all pairs, marks by plain patterns, tokens by the library."""
    import public_tokenizers
    from codeloom.llm import pii, quality_cnn
    from tokenizers import Tokenizer

    found = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], DATA).cache())
    rows = [[r.asDict() for r in df.collect()] for df in found]
    net = quality_cnn.train(found[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_cnn.score(found[0], net).collect()}
    assert {r["doc_id"] for r in rows[1]} == {i for i, x in scores.items() if x >= 0.7}

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows[1]))
    kept = {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op1_quality_rules']})").fetchall() if k}
    assert {r["doc_id"] for r in rows[2]} == kept

    texts = {r["doc_id"]: r["text"] for r in rows[2]}
    prints, sets = {i: print_of(t) for i, t in texts.items()}, {i: set(shingles_of(t, 5)) for i, t in texts.items()}
    at = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and at[i] != at[j] and ((prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = {k: new if v == old else v for k, v in at.items()}
    assert {r["doc_id"] for r in rows[3]} == set(at.values())

    terms = {r["term"]: r["share"] for r in pii.disclosing(found[3]).collect()}
    assert {r["doc_id"]: r["text"] for r in rows[4]} == {r["doc_id"]: marked(r["text"], terms) for r in rows[3]}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows[5], key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
        places[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert ids == {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in rows[4]}
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *[b for _, b in p[:-1]]] and p[-1][1] <= 1024


CLEAN = "A plain report on the house over the hill, written by hand in the year of the flood, number {} of many; it tells of rain, wind, mud, boats, ropes, bread, salt, lamps and letters that people sent from town to town while roads lay under deep water and bridges broke, and of those who came back later with {} carts to build again what had been lost."


@pytest.mark.parametrize("rows", ["empty", "edge"])
def test_pipeline_on_edge_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, piece int, fp string"
    texts = [] if rows == "empty" else [None, "", " ", *[CLEAN.format(k, 7 * k * k) for k in range(6)], CLEAN.format(1, 7), "x" * 50_000, CLEAN.format(9, 9) + " mail me@example.org"]
    data = [(k, t, None, "s", None, "s", 1, None) for k, t in enumerate(texts)] + [(None, CLEAN.format("none", 5), "en", "s", 3, "s", 1, "f")] * bool(texts)
    data += [data[4]] * 2 if texts else []
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    kept = docs.collect()
    assert bool(kept) == bool(texts)
    if texts:
        ids = [r["doc_id"] for r in kept]
        assert 4 in ids and None in ids and 0 not in ids and 10 not in ids and len(ids) == len(set(ids))
        masked = [r for r in kept if r["doc_id"] == 11]
        assert all(r["text"].endswith("mail [email]") and r["n_chars"] == len(r["text"]) for r in masked)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept}


def test_pipeline_yields_token_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(k, CLEAN.format(k, 7 * k) * (1 + 30 * k)) for k in range(3)], "doc_id long, text string")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    for d in docs.collect():
        own = sorted((r["start"], r["ids"]) for r in pieces if r["doc_id"] == d["doc_id"])
        assert sum((ids for _, ids in own), []) == [*library.encode(d["text"], add_special_tokens=False).ids, 2]
    whole = corpus_pipeline.sequences(spark, DATA)
    assert whole.filter("size(ids) = length").count() == whole.count() > 0
