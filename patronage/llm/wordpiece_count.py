"""Word-piece token counts by a linear longest-match automaton.

A trie holds the vocabulary, pieces that start a word below one root and
continuations below another. Every node has a failure link: the node reached
by giving up the longest pieces of its string, with how many pieces that gives
up counted beforehand. Reading a character either follows the trie or pops:
the greedy longest-match length of a word is found in one pass over its
characters and no piece is built. A word that cannot be matched to its end is
one unknown token.

Words are runs of characters other than U+0020 and U+0009-U+000D, read as
they are. Counts of words already met are kept (a bounded number).

Defined cases: a null or empty text has no words and no tokens; rows and
repeated rows are kept one for one; without a vocabulary every word is unknown.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import CACHE_WORDS, column_udf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = MODEL) -> tuple[list[str], list[str]]:
    """(pieces that start a word, continuations) of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return ([p[1:] for p in plain if p[0] == "▁" and p.strip("▁")],
            [p for p in plain if "▁" not in p])


class Automaton:
    """count(word): greedy longest-match tokens, or -1 where there is no match."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: continuation
        ends = set()
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                state = root
                for c in piece:
                    nxt = self.go[state].get(c)
                    if nxt is None:
                        nxt = self.go[state][c] = len(self.go)
                        self.go.append({})
                    state = nxt
                if state > 1:
                    ends.add(state)
        n = len(self.go)
        self.fail = [-1] * n
        self.popped = [0] * n
        queue = deque([0, 1])
        while queue:
            up = queue.popleft()
            for c, v in self.go[up].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, given = self.fail[up], self.popped[up]
                while z >= 0 and c not in self.go[z]:
                    given += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.go[z][c], given

    def count(self, word: str) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        state, n = 0, 0
        for c in word:
            while (nxt := go[state].get(c)) is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return -1
            state = nxt
        while state != 1:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return -1
        return n


_COUNTS = StructType([StructField("n_words", LongType()), StructField("n_tokens", LongType()),
                      StructField("n_unknown", LongType())])


def counts(docs: DataFrame, pieces: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else vocabulary())

    def counter():
        automaton = Automaton(*shared.value)
        known: dict[bytes, int] = {}

        def f(text):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            new = [w for w in set(words) if w not in known]
            if new:
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = set(words)
                for w in new:
                    known[w] = automaton.count(w.decode("utf-8", "surrogatepass"))
            each = list(map(known.__getitem__, words))
            unknown = each.count(-1)
            return len(words), sum(each) + 2 * unknown, unknown
        return f

    return docs.select("doc_id", column_udf(counter, _COUNTS)(F.col("text")).alias("c")).select("doc_id", "c.*")
