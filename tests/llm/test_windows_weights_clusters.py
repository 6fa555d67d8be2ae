"""Decontamination, importance resampling and centroid clusters against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import centroid_clusters, decontaminate, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def items(spark, rows):
    """Windows of documents, short items, repeated and null items, other columns."""
    text = {i: t for i, t, _ in rows if i is not None}
    long = text[112].split()
    out = [(10, " ".join(long[45:75])), (9, " ".join(long[50:65]).upper()), (9, " ".join(long[50:62])),
           (100, " ".join(text[5].split()[:9])), (101, "ONE"), (102, " ".join(text[7].split()[3:7])), (103, "日本語 🙂"),
           (104, ""), (105, None), (106, " .,;\x00"), (None, " ".join(text[8].split()[:12])), (107, "ab " * 30),
           (108, "nothing of this is in any document at all, or is it not so"), (110, "ab " * 12)]
    return spark.createDataFrame([r + (1, "x", None) for r in out], "item_id long, text string, row int, w string, window int"), out


def brute_windows(rows, items, size=10):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, t, _ in rows:
        w, hit, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found is not None:
                    hit |= set(range(i, i + n))
                    held |= found
        held = sorted(str(x) for x in held if x is not None)
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit), hit))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize(("size", "broadcast"), [(10, 10**6), (10, 0), (3, 10**6)])
def test_windows_equal_brute_force(corpus, rows, items, monkeypatch, size, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    got = [tuple(r) for r in decontaminate.digest(corpus, items[0], size).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    want = [r[:6] for r in brute_windows(rows, items[1], size)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[5] for r in want) > 12


def test_windows_of_every_length(spark):
    rng = random.Random(2)
    some = ["a", "b", "c"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(0, 60))), None) for i in range(80)]
    items = [(i, " ".join(rng.choice(some) for _ in range(6 + i % 8))) for i in range(12)]
    got = decontaminate.digest(spark.createDataFrame([r[:2] for r in docs], "doc_id int, text string"),
                               spark.createDataFrame(items, "item_id int, text string")).collect()
    want = brute_windows(docs, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted(r[:4] for r in want)


def test_cleaned_spans_and_documents(corpus, rows, items):
    want = {r[0]: r for r in brute_windows(rows, items[1])}
    got = decontaminate.cleaned(corpus, items[0])
    assert got.columns == corpus.columns and got.count() == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got.where("doc_id IS NOT NULL").collect():
        hit = want[r.doc_id][6]
        if not hit:
            assert r.text == texts[r.doc_id]
        assert words(r.text) == [w for k, w in enumerate(words(texts[r.doc_id])) if k not in hit]
    left = decontaminate.cleaned(corpus, items[0], "documents")
    assert left.count() == sum(not r[5] for r in brute_windows(rows, items[1]))
    with pytest.raises(ValueError):
        decontaminate.cleaned(corpus, items[0], "lines")


def test_windows_empty_tables(spark, corpus, items):
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.digest(corpus, nothing)
    assert got.count() == corpus.count() and got.where("contaminated OR n_hit > 0 OR n_items > 0").isEmpty()
    assert decontaminate.digest(corpus.limit(0), items[0]).count() == 0


def test_windows_plan_is_native(corpus, items):
    from patronage.llm.common import Scratch
    scratch = Scratch(corpus.sparkSession)
    known = decontaminate.windows(items[0])
    plan = decontaminate._scan(corpus, scratch.keep(decontaminate._chunk_set(known, [10])), True, [5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    scratch.clear()
    assert "BroadcastHashJoin" in text and not re.search("Python|Pandas|Arrow", text)


def brute_scores(rows, target, seed=42, least=20, percent=5, buckets=10_000):
    def features(t):
        w = words(t)
        grams = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]
    docs = [(i, *features(t)) for i, t, _ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_importance_equals_brute_force(corpus, rows, items):
    got = [tuple(r) for r in importance_resample.score(corpus, items[0], percent=30).select(
        "doc_id", "n_features", "weight", "score", "rank").collect()]
    want = brute_scores(rows, [t for _, t in items[1]], percent=30)
    assert sorted(got, key=lambda r: (key(r[:4]), r[4] or 0)) == sorted(want, key=lambda r: (key(r[:4]), r[4] or 0))
    drawn = {r[0] for r in want if r[4]}
    assert {r.doc_id for r in importance_resample.resampled(corpus, items[0], percent=30).collect()} == drawn
    assert len(drawn) > 20


def test_importance_draws_what_is_like_the_target(spark):
    rng = random.Random(9)
    a, b = ["alpha%d" % i for i in range(50)], ["beta%d" % i for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(a if i % 10 else b, k=40))) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(b, k=40)),) for _ in range(20)], "text string")
    drawn = importance_resample.score(docs, target).where("rank IS NOT NULL").collect()
    assert len(drawn) == 20 and all(r.doc_id % 10 == 0 for r in drawn)


def test_importance_large_ids(spark):
    rows = [(2**60 + i, "word%d " % i * 30, None) for i in range(50)] + [(None, "some text", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    got = importance_resample.score(docs, docs.select("text").limit(3), percent=50).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and sum(r.rank is not None for r in got) == 25


def test_importance_empty_tables(spark, corpus):
    nothing = spark.createDataFrame([], "text string")
    assert importance_resample.score(corpus, nothing).count() == corpus.count()
    assert importance_resample.score(corpus.limit(0), nothing).count() == 0


def brute_clusters(vectors, k=8, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, n) in zip(kept, at, strict=True) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    inertia = Counter()
    for dist, n in at:
        inertia[n] += dist
    return [(i, n, dist, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())
            for (i, _), (dist, n) in zip(kept, at, strict=True)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    heart = rng.normal(0, 0.3, (5, 64))
    rows = [(i, [float(x) for x in np.float32(heart[i % 5] + rng.normal(0, 0.1, 64))]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(100)]  # a hot vector
    bad = list(rows[0][1])
    rows += [(400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [None, *bad[1:]]), (405, [math.nan, *bad[1:]]),
             (406, [math.inf, *bad[1:]]), (407, [0.0] * 64), (408, [-1e5] * 64), rows[3], (None, bad), (2**60 + 1, rows[9][1]), (409, [-0.00001] * 64)]
    return spark.createDataFrame([r + (1, "x", 2) for r in rows],
                                 "vec_id long, embedding array<float>, label int, ids string, n int").repartition(4).cache()


@pytest.mark.parametrize(("width", "chunk", "k"), [(1, 8192, 8), (3, 32, 8), (64, 8192, 3)])
def test_clusters_equal_brute_force(vectors, monkeypatch, width, chunk, k):
    monkeypatch.setattr(centroid_clusters, "CHUNK", chunk)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = [tuple(r) for r in centroid_clusters.cluster(vectors, k, width=width).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    want = brute_clusters(rows, k)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(got) == 300 + 6


def test_clusters_few_vectors_and_none(vectors):
    few = vectors.where("vec_id IN (1, 2, 407)")
    got = centroid_clusters.cluster(few).collect()
    assert len(got) == 3 and {r.distance for r in got} == {0} and {r.inertia for r in got} == {0}
    assert centroid_clusters.cluster(few.where(F.lit(False))).count() == 0


def test_encoding_is_lossless():
    v = np.random.default_rng(1).integers(-5, 5, (300, 64))
    for width in (1, 2, 5, 64):
        row = centroid_clusters.encode(v, width)
        back = np.concatenate([own[code] for _, own, code in centroid_clusters.blocks(row, 64, width)], axis=1)
        assert (back == v).all()
