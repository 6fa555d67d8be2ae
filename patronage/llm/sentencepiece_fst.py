"""SentencePiece encoding and decoding by weighted finite-state transducers.

The tokenizer is the composition of three transducers, compiled once from the
model file: the normaliser (a dummy prefix, spaces to U+2581), the pieces (a
trie closed under repetition, the output and weight on the arc that ends a
piece) and byte fallback (any character to its byte pieces). A literal U+2581
is no space and leaves the normaliser only towards the bytes. Composing with
an input gives an acyclic lattice over its positions; the encoding is its
shortest path in the tropical semiring (min, +). Of equal paths the one whose
last piece is longest counts, from the end on.

A unigram model's weights are its negated scores. A merge model has ranks for
scores; rank r weighs as Zipf's law would: log(2 + r) + log(vocabulary). Its
encodings are thus shortest paths and not merge sequences; both decode alike.

No piece crosses from another character to U+2581, nor a control character
that is in no piece, so the lattice has a single state at every word start: it
is solved segment by segment, many segments of a batch at once in numpy, and
the shortest paths of segments already met are kept (a bounded number).

Defined cases: null gives null ids and no tokens; empty text gives no ids and
decodes to empty text; every other text, white space and U+2581 included,
decodes to itself if the model leaves text as it is and has all byte pieces.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import CACHE_WORDS, batch_udf, column_udf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments solved at a time, and the longest that is solved with others.
_GROUP, _LONG = 10_000, 48
#: Texts encoded together.
_SLICE = 500


@dataclass(frozen=True)
class Pieces:
    """What the transducers are compiled from: ordinary pieces, byte pieces, weights by id."""
    text: dict[str, int]
    byte: list[int]
    weight: list[float]
    names: list[str] = field(repr=False)
    unknown: int = 0


def load(path: str = MODEL) -> Pieces:
    """Read a model file; half a megabyte, sent to the tasks as it is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    byte = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte[int(names[i][3:5], 16)] = i
    ranks = all(scores[i] == int(scores[i]) for i in plain)  # of merges
    weight = [math.log(2 - s) + math.log(n) if ranks and s <= 0 else -s for s in scores]
    worst = max(weight[i] for i in plain) if plain else 0.0
    for i in byte:
        if i >= 0:
            weight[i] = worst + 1.0
    return Pieces({names[i]: i for i in plain}, byte, weight, names, sp.unk_id())


class Transducer:
    """The compiled composition; ``encode`` composes it with an input."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for s, i in pieces.text.items():
            state = 0
            for c in s:
                state = self.trie[state].setdefault(c, len(self.trie))
                if state == len(self.trie):
                    self.trie.append({})
                    self.final.append(-1)
            self.final[state] = i
        self.known: dict[str, bytes] = {}
        alphabet = sorted(set("".join(pieces.text)))
        outside = "".join(c for c in map(chr, range(32)) if c not in alphabet)
        self.segment = re.compile(f"[{re.escape(outside)}]|{SPACE}*[^{SPACE}{re.escape(outside)}]*" if outside
                                  else f"{SPACE}*[^{SPACE}]*")
        # the same trie for numpy: state * alphabet + character, sorted
        self.points = np.array([ord(c) for c in alphabet], np.int64)
        place = {c: i for i, c in enumerate(alphabet)}
        arcs = sorted((state * len(alphabet) + place[c], to) for state, out in enumerate(self.trie) for c, to in out.items())
        self.arc = np.array([x for x, _ in arcs] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([x for _, x in arcs] + [0], np.int64)
        self.ends = np.array(self.final, np.int64)
        self.weights = np.array(pieces.weight)
        byte = {i: bytes([b]) for b, i in enumerate(pieces.byte) if i >= 0}
        plain = set(pieces.text.values())
        self.out = [byte.get(i, s.replace(SPACE, " ").encode() if i in plain else b"")
                    for i, s in enumerate(pieces.names)]

    @staticmethod
    def normalise(text: str) -> list[str]:
        """The normalised text, cut where a literal U+2581 stood."""
        return [x.replace(" ", SPACE) for x in (" " + text).split(SPACE)] if text else []

    def fallback(self, char: str) -> list[int]:
        ids = [self.p.byte[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.p.unknown] if -1 in ids else ids

    def shortest(self, s: str) -> list[int]:
        """Shortest path through the lattice of a normalised segment."""
        n = len(s)
        best = [math.inf] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        trie, final, weight = self.trie, self.final, self.p.weight
        for i in range(n):
            here = best[i]
            state = 0
            whole = False
            for j in range(i, n):
                state = trie[state].get(s[j], -1)
                if state < 0:
                    break
                piece = final[state]
                if piece >= 0:
                    whole |= j == i
                    w = here + weight[piece]
                    if w < best[j + 1]:
                        best[j + 1], back[j + 1] = w, (i, piece)
            if not whole:
                w = here + sum(weight[x] for x in self.fallback(s[i]))
                if w < best[i + 1]:
                    best[i + 1], back[i + 1] = w, (i, -1)
        out: list[int] = []
        while n:
            i, piece = back[n]
            out += [piece] if piece >= 0 else self.fallback(s[i])[::-1]
            n = i
        return out[::-1]

    def _solve(self, words: list[str]) -> list[bytes]:
        """``shortest`` of segments of at most _LONG characters, longest first, all at once."""
        size = np.array([len(w) for w in words])
        m, longest, letters = len(words), int(size[0]), len(self.points)
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, cp), letters - 1)
        char = np.full((m, longest), -1, np.int32)
        cell = np.arange(longest) < size[:, None]
        char[cell] = np.where(self.points[at] == cp, at, -1)
        byte = np.zeros((m, longest))  # weight of the way over bytes, where no piece is the character itself
        single = {c for c in set("".join(words)) if c not in self.p.text}
        odd = [c in single for w in words for c in w] if single else None
        if odd:
            byte[cell] = [sum(self.p.weight[x] for x in self.fallback(c)) if o else 0.0
                          for o, c in zip(odd, "".join(words), strict=True)]
        best = np.full((m, longest + 1), np.inf)
        best[:, 0] = 0
        back = np.zeros((m, longest + 1), np.int32)
        piece = np.full((m, longest + 1), -1, np.int32)
        for i in range(longest):
            live = np.arange(np.searchsorted(-size, -i))  # sorted by length: those longer than i
            state = np.zeros(len(live), np.int64)
            for j in range(i, longest):
                c = char[live, j]
                key = np.where(c >= 0, state * letters + c, -1)
                pos = np.searchsorted(self.arc, key)
                ok = self.arc[pos] == key
                live, state = live[ok], self.to[pos[ok]]
                if not len(live):
                    break
                end = self.ends[state]
                hit = end >= 0
                w, e = live[hit], end[hit]
                cost = best[w, i] + self.weights[e]
                less = cost < best[w, j + 1]
                w, e = w[less], e[less]
                best[w, j + 1], back[w, j + 1], piece[w, j + 1] = cost[less], i, e
            if odd:
                w = np.flatnonzero(byte[:, i] > 0)
                cost = best[w, i] + byte[w, i]
                w, cost = w[cost < best[w, i + 1]], cost[cost < best[w, i + 1]]
                best[w, i + 1], back[w, i + 1], piece[w, i + 1] = cost, i, -1
        steps, pos, live = [], size.copy(), np.arange(m)
        while len(live):
            step = np.full(m, -2)
            step[live] = piece[live, pos[live]]
            pos[live] = back[live, pos[live]]
            steps.append(step)
            live = live[pos[live] > 0]
        path = np.array(steps[::-1]).T
        rows = path != -2
        raw = path[rows].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(rows.sum(axis=1))).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero((path == -1).any(axis=1)).tolist():  # paths over bytes
            out[i] = np.array(self.shortest(words[i]), np.int32).tobytes()
        return out

    def learn(self, segments: Iterable[str]) -> None:
        """Keep the shortest paths of new segments."""
        segments = set(segments)
        new = {w for w in segments if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = segments
        short = sorted((w for w in new if 0 < len(w) <= _LONG), key=len, reverse=True)
        for i in range(0, len(short), _GROUP):
            self.known.update(zip(short[i:i + _GROUP], self._solve(short[i:i + _GROUP]), strict=True))
        for w in new:
            if not 0 < len(w) <= _LONG:
                self.known[w] = np.array(self.shortest(w), np.int32).tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Piece ids of each text."""
        group: list[list[list[str]]] = []
        size = 0
        bar = np.array(self.fallback(SPACE), np.int32).tobytes()

        def solved():
            self.learn(w for parts in group for words in parts for w in words)
            for parts in group:
                yield np.frombuffer(bar.join(b"".join(map(self.known.__getitem__, words)) for words in parts), np.int32)

        for text in texts:
            group.append([self.segment.findall(part) for part in self.normalise(text)])
            size += len(text)
            if size > 1_000_000:  # characters; bounds what is held at once
                yield from solved()
                group, size = [], 0
        yield from solved()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids: the inverted transducers."""
        raw = b"".join(map(self.out.__getitem__, ids))
        return raw[raw.startswith(b" "):].decode("utf-8", "replace")


_ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
_DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                      StructField("round_trip", BooleanType())])


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs without text, with n_tokens and ids (columns of these names are replaced).

    Works on slices of the Arrow batches, so that a task holds the ids of
    ``_SLICE`` texts and not of a whole batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # the vocabulary
    rest = [c for c in docs.columns if c not in ("text", *_ENCODED.names)]

    def run(batches):
        t = Transducer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = part.column("text").to_pylist()
                ids = list(t.encode(x or "" for x in texts))
                ends = np.cumsum([0, *map(len, ids)])
                none = np.array([x is None for x in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()),
                                                 mask=pa.array(none))
                counts = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), counts, lists], [*rest, *_ENCODED.names])

    schema = StructType([docs.schema[c] for c in rest] + _ENCODED.fields)
    return docs.select(*rest, "text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """tokens with the text of their ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))

    def decoder():
        t = Transducer(shared.value)
        return lambda ids: None if ids is None else t.decode(ids)

    return tokens.withColumn("text", column_udf(decoder, "string")(F.col("ids")))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit little-endian numbers), round_trip for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        t = Transducer(shared.value)

        def f(texts):
            texts = [x or "" for x in texts]
            return [(len(i), hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(), t.decode(i.tolist()) == x)
                    for x, i in zip(texts, t.encode(texts), strict=True)]
        return f

    return docs.select("doc_id", batch_udf(make, _DIGEST)(F.col("text")).alias("r")).select("doc_id", "r.*")
