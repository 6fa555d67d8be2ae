"""Quality rules with line sequence labelling.

Counts of a whole text decide a base rule; a linear-chain conditional random
field then marks every line as content or boilerplate (Viterbi) and the words
in content lines decide retention. The field has binary line features, one
weight for each feature and state, and transition weights; it is learned by
stochastic gradient descent on the conditional likelihood, with numpy, from a
bounded hash-ordered sample of labelled documents (``max_train``). Lines have
no labels of their own: those of a document marked 0 count as boilerplate,
all others as content. As such documents are of one state throughout, every
other step puts a run of lines of a document of the other class into the
document, so that the field learns to change its state within a text.

Words are runs of characters other than U+0020 and U+0009-U+000D everywhere.

Defined cases: a null or empty text has no words and fails the base rule; a
text whose lines hold no words is not kept; without labels of both classes
every line is content; rows and repeated rows are kept one for one.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import WORD, column_udf, hash_words, mix64

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Share of a text's words in content lines that keeps it.
CONTENT = 0.5
N_FEATURES = 18
#: Most lines of another document that a training step puts into a document.
MIXED = 8

_WORDS = re.compile(WORD)


@dataclass(frozen=True)
class Params:
    max_train: int = 1500
    epochs: int = 6
    rate: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Field:
    """emit: (2, N_FEATURES), move: (2, 2) from state to state; state 1 is content."""
    emit: np.ndarray
    move: np.ndarray


def line_features(lines: list[str]) -> np.ndarray:
    """Binary features, a row for each line."""
    out = np.zeros((len(lines), N_FEATURES), np.uint8)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = _WORDS.findall(line)
        n = len(words)
        row = out[i]
        row[0] = 1
        if not n:
            row[1] = 1
            continue
        chars = sum(map(len, words))
        signs = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        row[2 if n <= 2 else 3 if n <= 5 else 4 if n <= 20 else 5] = 1
        row[6] = 100 * signs > 2 * chars
        row[7] = 100 * signs > 10 * chars
        row[8] = 3 * line.count("|") > n
        row[9] = 2 * upper > n and n > 1
        row[10] = 4 * line.count("!!") > n
        row[11] = 10 * sum(map(str.isdigit, line)) > 3 * chars
        row[12] = line.rstrip(SPACES)[-1] in ".!?:;\"'"
        row[13] = line in seen
        row[14] = n > 4 and 10 * sum(map(str.__eq__, words, words[1:])) > 2 * n
        row[15] = n > 9 and 2 * len(set(words)) < n
        row[16] = chars > 15 * n
        row[17] = "://" in line or "www." in line or "@" in line
        seen.add(line)
    return out


def viterbi(x: np.ndarray, field: Field) -> np.ndarray:
    """The best state of every line; of equals, content."""
    u = x @ field.emit.T
    m00, m01, m10, m11 = field.move.ravel().tolist()
    a, b = u[0].tolist()
    back = []
    for s0, s1 in u[1:].tolist():
        from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
        back.append((from0, from1))
        a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
    state = b >= a
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return np.array(out[::-1], bool)


def _expected(u: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and transition expectations of a line sequence (forward-backward)."""
    n = len(u)
    e = np.exp(u - u.max(axis=1, keepdims=True))
    m = np.exp(move)
    f, b = np.empty((n, 2)), np.ones((n, 2))
    f[0] = e[0] / e[0].sum()
    for i in range(1, n):
        f[i] = (f[i - 1] @ m) * e[i]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = m @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = f * b
    p /= p.sum(axis=1, keepdims=True)
    pairs = f[:-1, :, None] * m[None] * (e[1:] * b[1:])[:, None, :]
    if n > 1:
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return p, pairs.sum(axis=0)


def _mix(x: np.ndarray, y: int, other: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a document of class y around a run of lines of one of the other class, with their states."""
    n = int(rng.integers(1, min(MIXED, len(other)) + 1))
    start, at = int(rng.integers(len(other) - n + 1)), int(rng.integers(len(x) + 1))
    return (np.concatenate([x[:at], other[start:start + n], x[at:]]),
            np.concatenate([np.full(at, y), np.full(n, 1 - y), np.full(len(x) - at, y)]))


def train(rows: list[tuple[np.ndarray, int]], p: Params) -> Field:
    """Stochastic gradient descent over (features, label of all its lines) documents and mixtures of two."""
    emit, move = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    if len({y for _, y in rows}) < 2:
        return Field(emit, move)
    of_class = [[x for x, y in rows if y == c] for c in (0, 1)]
    rng, total, step = np.random.default_rng(p.seed), p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            state = np.full(len(x), y)
            if step % 2:
                x, state = _mix(x, y, of_class[1 - y][int(rng.integers(len(of_class[1 - y])))], rng)
            rate = p.rate * (1 - step / total) / len(x)
            step += 1
            states, moves = _expected(x @ emit.T, move)
            gold = np.eye(2)[state]
            gold_moves = gold[:-1].T @ gold[1:]
            emit += rate * ((gold - states).T @ x) - 1e-5 * emit
            move += rate * (gold_moves - moves) - 1e-5 * move
    return Field(emit, move)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Field:
    """Fit on at most ``params.max_train`` labelled documents, chosen by a hash of doc_id."""
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train))
    features = column_udf(lambda: lambda t: line_features(t.split("\n")).tobytes(), "binary")
    rows = (docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", features("text").alias("x"), "quality").toPandas().sort_values(["doc_id", "x"]))
    return train([(np.frombuffer(x, np.uint8).reshape(-1, N_FEATURES).astype(float), int(y))
                  for x, y in zip(rows["x"], rows["quality"], strict=True)], params)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by runs of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = hash_words(words)
    g = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    return int(WINDOW + np.minimum(np.diff(at), WINDOW).sum())


_RESULT = StructType([StructField("n_words", LongType()), StructField("word_chars", LongType()),
                      StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
                      StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
                      StructField("content_share", DoubleType()), StructField("kept", BooleanType())])


def judge(text: str | None, field: Field) -> tuple:
    """The values of _RESULT for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    with np.errstate(over="ignore"):
        repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT * len(words)
    x = line_features(lines)
    content = viterbi(x, field)
    sizes = [len(_WORDS.findall(x)) for x in lines]
    total = sum(sizes)
    share = sum(s for s, c in zip(sizes, content, strict=True) if c) / total if total else 0.0
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(full) - len(set(full)), repeated, failed, share, not failed and share >= CONTENT)


def decide(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept for every row of docs."""
    field = fit(docs, labels, params)  # a few dozen numbers
    rule = column_udf(lambda: lambda t: judge(t, field), _RESULT)
    return docs.select("doc_id", rule(F.col("text")).alias("r")).select("doc_id", "r.*")
