"""Quality classifier: supervised subword embeddings.

A word contributes itself and its character n-grams (of ``<word>``), each
hashed into a table of learned vectors; a marker feature says that a word
equals the one before. A document is the mean of its feature vectors, a
linear layer with softmax gives the class. numpy stochastic gradient descent
learns table and layer from a bounded, hash-ordered sample of labelled rows
(``max_train``). Because the layer is linear in the mean, scoring needs only
one number for each feature, ``E[f] . (W1 - W0)``: that table is what tasks get.

Defined cases: a null or empty text has the zero vector, its score is that of
the bias; rows, columns and repeated rows of the input are kept as they are;
without labels of both classes every score is 0.5.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, batch_udf, column_udf, hash_words, mix64

THRESHOLD = 0.3
_SAME = b"\x00same"
#: Words whose features are made together, and texts scored together.
_GROUP, _TEXTS = 20_000, 500
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    dim: int = 16
    ngrams: tuple[int, ...] = (2, 3, 4)
    max_train: int = 4000
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """weight: one number a feature bucket; bias: of the logit; params as trained."""
    weight: np.ndarray
    bias: float
    params: Params


def word_features(words: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their n-grams, word after word, and how many each has."""
    mask = np.uint64(p.buckets - 1)
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + bytes(max(p.ngrams)), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    counts = 1 + sum(np.maximum(size - n + 1, 0) for n in p.ngrams)
    out = np.empty(int(counts.sum()), np.int64)
    at = np.cumsum(counts) - counts
    out[at] = hash_words(words) & mask
    at = at + 1
    for n in p.ngrams:  # an n-gram of up to seven bytes is a number
        have = np.maximum(size - n + 1, 0)
        value = np.full(len(text) - max(p.ngrams), n, np.uint64)
        for i in range(n):
            value = (value << np.uint64(8)) | text[i:i + len(value)]
        bucket = (mix64(value * _SPREAD) & mask).astype(np.int64)
        within = np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have)
        out[np.repeat(at, have) + within] = bucket[np.repeat(end - size, have) + within]
        at = at + have
    return out, counts


def word_sums(words: list[bytes], weight: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each word's features, and how many it has."""
    mask = np.uint64(p.buckets - 1)
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + bytes(max(p.ngrams)), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(int(size.sum()))  # bytes to the word's end
    sums = weight[(hash_words(words) & mask).astype(np.int64)]
    counts = np.ones(len(words), np.int64)
    for n in p.ngrams:
        value = np.full(len(left), n, np.uint64)
        for i in range(n):
            value = (value << np.uint64(8)) | text[i:i + len(value)]
        w = weight[(mix64(value * _SPREAD) & mask).astype(np.int64)]
        sums = sums + np.add.reduceat(np.where(left >= n, w, 0.0), start)
        counts += np.maximum(size - n + 1, 0)
    return sums, counts


def _same_bucket(p: Params) -> int:
    return int(hash_words([_SAME])[0]) & (p.buckets - 1)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_features(text: str | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares (sum 1)."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    often = Counter(words)
    ids, counts = word_features(list(often), p)
    times = np.bincount(ids, np.repeat(list(often.values()), counts), p.buckets)
    times[_same_bucket(p)] += sum(map(eq, words, words[1:]))
    at = np.flatnonzero(times)
    return at.astype(np.int32), (times[at] / times.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> Model:
    """Stochastic gradient descent over (buckets, shares, label) rows."""
    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
    layer, bias = np.zeros((2, p.dim)), np.zeros(2)
    if len({y for _, _, y in rows}) < 2:
        return Model(np.zeros(p.buckets, np.float32), 0.0, p)
    total, step = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            at, share, y = rows[i]
            rate = p.rate * (1 - step / total)
            step += 1
            v = share @ table[at]
            z = layer @ v + bias
            q = np.exp(z - z.max())
            g = q / q.sum()
            g[y] -= 1
            dv = g @ layer
            layer -= rate * g[:, None] * v
            bias -= rate * g
            if len(at):
                # a mean of n vectors moves by rate * dv when its features share the step
                table[at] -= (rate / max(float(share @ share), 1e-6)) * share[:, None] * dv
    w = table @ (layer[1] - layer[0])
    return Model(w.astype(np.float32), float(bias[1] - bias[0]), p)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fit on at most ``params.max_train`` labelled rows, chosen by a hash of doc_id.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used. Labels other
    than 0 and 1 are ignored; of several labels of one document the least counts.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train))
    p = params

    def encoded():
        def f(text):
            at, share = text_features(text, p)
            return at.tobytes() + share.tobytes()
        return f

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train ids
            .select("doc_id", column_udf(encoded, "binary")("text").alias("f"), "quality")
            .toPandas().sort_values(["doc_id", "f"]))  # at most max_train feature lists
    data = []
    for f, y in zip(rows["f"], rows["quality"], strict=True):
        n = len(f) // 8
        data.append((np.frombuffer(f, np.int32, n), np.frombuffer(f, np.float32, n, 4 * n), int(y)))
    return train(data, params)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the softmax share of class 1 of every whole text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((zlib.compress(model.weight.tobytes(), 1), model.bias, model.params))  # buckets x 4 bytes

    def scorer():
        packed, bias, p = shared.value
        weight = np.frombuffer(zlib.decompress(packed), np.float32).astype(np.float64)
        same = float(weight[_same_bucket(p)])
        total: dict[bytes, float] = {}  # of a word's features, and how many it has
        many: dict[bytes, int] = {}

        def learn(new):
            for i in range(0, len(new), _GROUP):
                sums, counts = word_sums(new[i:i + _GROUP], weight, p)
                total.update(zip(new[i:i + _GROUP], sums.tolist(), strict=True))
                many.update(zip(new[i:i + _GROUP], counts.tolist(), strict=True))

        def rate(words):
            twins = sum(map(eq, words, words[1:]))
            n = sum(map(many.__getitem__, words)) + twins
            z = bias + ((sum(map(total.__getitem__, words)) + same * twins) / n if n else 0.0)
            return 1 / (1 + np.exp(-z)) if z > -700 else 0.0

        def f(texts):
            out = []
            for i in range(0, len(texts), _TEXTS):
                group = [_words(t) for t in texts[i:i + _TEXTS]]
                words = set().union(*group)
                new = [w for w in words if w not in total]
                if len(total) + len(new) > CACHE_WORDS:
                    total.clear()
                    many.clear()
                    new = list(words)
                learn(new)
                out += map(rate, group)
            return out
        return f

    return docs.withColumn(column, batch_udf(scorer, "double")(F.col("text")))


def predict(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, params)).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with the columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, fit(docs, labels, params)).where(F.col("score") >= threshold).select("row.*")
