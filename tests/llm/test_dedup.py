"""MinHash, suffix and embedding deduplication against brute force."""
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.llm import embedding_dedup, minhash_dedup, sql, suffix_dedup
from patronage.llm.common import Scratch, components, shingles


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_components(rows, size):
    sets = [(i, set(shingles(t, size).tolist())) for i, t, *_ in rows if i is not None]
    u = Union()
    for n, (i, x) in enumerate(sets):
        u.find(i)
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u.join(i, j)
    return {i: u.find(i) for i, _ in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(corpus, rows, size):
    got = minhash_dedup.classify(corpus, size).collect()
    want = brute_components(rows, size)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert len(got) == len(set(r.doc_id for r in got))
    assert {r.doc_id: r.n_shingles for r in got}[121] == 1
    assert {r.doc_id: r.n_shingles for r in got}[119] == 0


def test_minhash_dense_region(spark):
    """A region wider than the window: many near copies of one text and of a second one close to it."""
    rng = np.random.default_rng(3)
    base = ["w%d" % i for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(200, 2 if i < 100 else 6, replace=False):
            words[k] = "q%d" % rng.integers(10**9)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.classify(docs, 2).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize(("copies", "block"), [(40, 8192), (200, 64), (2000, 8192)])
def test_minhash_star(spark, monkeypatch, copies, block):
    """Copies that are similar to their base only, not to each other."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = ["w%d" % i for i in range(1000)]
    rows = [(0, " ".join(base))]
    for i in range(1, copies + 1):
        words = list(base)
        for k in rng.choice(1000, 81, replace=False):
            words[k] = "q%d" % rng.integers(10**9)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.classify(docs, 1).collect()}
    assert got == dict.fromkeys(range(copies + 1), 0)


def test_minhash_shared_licence(spark, monkeypatch):
    """Unlinked documents with 86 % common shingles (similarity 0.75) list next to no pairs; pairs above 0.8 among them are found."""
    rng = np.random.default_rng(6)
    licence = ["l%d" % i for i in range(429)]
    rows = [(i, " ".join(licence + ["u%d" % x for x in rng.integers(0, 10**9, 71)])) for i in range(1600)]
    for i in range(0, 400, 10):  # 43 of 71 own words changed in common: similarity about 0.83
        words = rows[i][1].split()
        rows.append((1600 + i, " ".join(words[:460] + ["u%d" % x for x in rng.integers(0, 10**9, 40)])))
    listed = []
    full = minhash_dedup.filtered

    def counted(*args):
        out = full(*args)
        listed.append(out.count())
        return out
    monkeypatch.setattr(minhash_dedup, "filtered", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash_dedup.classify(docs, 2).collect()}
    sets = {i: set(shingles(t, 2).tolist()) for i, t in rows}
    for i in range(0, 400, 10):
        assert 100 * len(sets[i] & sets[1600 + i]) >= 80 * len(sets[i] | sets[1600 + i])
        assert got[1600 + i] == i
    assert sum(c != i for i, c in got.items()) == 40
    assert listed[0] <= 3 * len(rows)


def test_minhash_empty_and_keep_one(spark, corpus, rows):
    assert minhash_dedup.classify(corpus.where("false")).collect() == []
    out = minhash_dedup.keep_one(corpus, 5)
    assert out.columns == corpus.columns
    want = brute_components([(k, t) for k, (_, t, _) in enumerate(rows)], 5)
    groups = {}
    for k, (i, *_) in enumerate(rows):
        groups.setdefault(want[k], []).append((i is None, i))
    ids = [(r.doc_id is None, r.doc_id) for r in out.collect()]
    assert Counter(ids) == Counter(min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values())


def test_keep_one_decides_by_row(spark):
    texts = ["one text of some words here", "a wholly different one of other words", "one text of some words here", "more " * 9]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (3, texts[2]), (None, texts[3]), (None, None), (None, None)],
                                 "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in minhash_dedup.keep_one(docs).collect())
    assert got == Counter([(7, texts[1]), (3, texts[2]), (None, texts[3]), (None, None), (None, None)])


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(300)
    links = [(int(a), int(b)) for a, b in zip(ids[:199], ids[1:200])] + [(int(ids[250]), int(ids[251]))]
    scratch = Scratch(spark)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    low = int(min(ids[:200]))
    assert got == {int(i): low for i in ids[:200]} | {int(i): int(min(ids[250:252])) for i in ids[250:252]}
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, scratch).collect() == []
    scratch.clear()


def brute_repeats(texts):
    n = suffix_dedup.LENGTH
    count = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i:i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_equals_brute_force(corpus, rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    want = Counter((i, *x) for (i, *_), x in zip(rows, brute_repeats(texts)))
    got = Counter(tuple(r) for r in suffix_dedup.digest(corpus).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffix_dedup.digest(corpus.where("false")).collect() == []


def test_suffix_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    got = Counter(con.execute("SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM (" + sql.REPEATED_STRINGS + ")").fetchall())
    assert got == Counter((i, *x) for (i, *_), x in zip(rows, brute_repeats([(t or "").encode() for _, t, _ in rows])))


def test_suffix_over_chunk_borders(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    texts = [a, a[:1700] + b"##" + a[1700:], a[2500:2699], a[2500:2700], b"z" * 900]
    got = [(len(t), *suffix_dedup._cut(t, [])[1:]) for t in texts]
    assert got == [(len(t), 0, 0) for t in texts]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_repeats(texts)
    with np.errstate(over="ignore"):
        whole = [(at + x).tolist() for at, _, x in suffix_dedup._chunks(a)][0]
        monkeypatch.setattr(suffix_dedup, "_CHUNK", 333)
        cut = [int(at + y) for at, _, x in suffix_dedup._chunks(a) for y in x]
    assert cut == whole


def test_suffix_cleaned_keeps_columns(corpus):
    out = suffix_dedup.without_repeats(corpus)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[119] is None and texts[118] == "" and texts[121] == "one"
    assert texts[60] == "" or len(texts[60]) < 200


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = rng.normal(size=64)
        rows.append((i, v.tolist(), int(i % 3)))
    base = rng.normal(size=64)
    for i in range(300, 420):  # a dense group
        rows.append((i, (base + rng.normal(size=64) * 0.1).tolist(), 1))
    for i in range(420, 440):
        rows.append((i, rows[i - 420][1], rows[i - 420][2]))
    for i in range(440, 460):
        rows.append((i, (np.array(rows[i - 400][1]) * 3).tolist(), rows[i - 400][2]))
    rows += [(460, None, 1), (461, [0.0] * 64, 1), (462, [1.0, None] + [0.0] * 62, 1), (463, [float("nan")] * 64, 1),
             (464, [float("inf")] + [0.0] * 63, 1), (465, rows[0][1], None), (None, rows[0][1], 0), (466, [1.0, 2.0], 1),
             (467, [1.0, 2.0], 1), (468, [], 1), (469, [5.0], 2), (470, [7.0], 2), rows[7], rows[7]]
    return rows


def brute_vectors(rows):
    rows = list({(i, None if v is None else tuple(map(str, v)), l): (i, v, l) for i, v, l in rows}.values())
    def ok(i, v, l):
        return i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, u = Counter(), Union()
    for n, (i, v, l) in enumerate(rows):
        if i is not None:
            u.find(i)
        for j, w, k in rows[:n]:
            if ok(i, v, l) and ok(j, w, k) and l == k and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    u.join(i, j)
    return {(i, links[i], u.find(i)) for i, *_ in rows if i is not None}


@pytest.mark.parametrize("block", [1500, 37])
def test_embeddings_equal_brute_force(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.classify(df.withColumn("size", F.lit("x"))).collect()
    assert {tuple(r)[:3] for r in got if r.vec_id is not None} == brute_vectors(vectors)
    assert len(got) == len({r[0] for r in vectors})
    assert embedding_dedup.classify(df.where("false")).collect() == []


def test_embeddings_of_768_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        base = rng.normal(size=768)
        rows += [(3 * i + k, (base + rng.normal(size=768) * 0.08 * k).tolist(), 1) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r)[:3] for r in embedding_dedup.classify(df).collect()} == brute_vectors(rows)
