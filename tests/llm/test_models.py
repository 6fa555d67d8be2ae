"""Classifier, line field, tokenizers: brute force, gradients, round trips, held-out accuracy."""
import itertools
import random

import numpy as np
import pytest

from patronage.llm import line_quality, quality_classifier, sentencepiece_fst, wordpiece_count

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        lines = [prose(rng, rng.randrange(5, 25)).rstrip(",.") + "." for _ in range(rng.randrange(2, 9))]
        if not good:
            lines = [" ".join(w + "###" for w in x.split()) if rng.random() < 0.8 else x for x in lines]
        docs.append((i, "\n".join(lines), "x"))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0), (7, 3, 0), (9999, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_classifier_held_out(labelled):
    docs, labels = labelled
    got = quality_classifier.predict(docs, labels).collect()
    truth = {i: i % 3 > 0 for i in range(240)}
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and 20 < len(held) < 90
    assert sum((r.predicted == 1) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_classifier_cases(spark, labelled, corpus):
    docs, labels = labelled
    got = quality_classifier.predict(corpus, labels).collect()
    assert len(got) == corpus.count() and all(r.score is not None for r in got)
    empty = {r.score for r in got if r.doc_id in (118, 119, 120)}
    assert len(empty) == 1
    none = quality_classifier.predict(corpus, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    out = quality_classifier.keep_good(corpus, labels)
    assert out.columns == corpus.columns
    assert quality_classifier.predict(corpus.where("false"), labels).collect() == []


def test_classifier_score_is_the_mean_of_its_features():
    p = quality_classifier.Params(buckets=1 << 10)
    rng = np.random.default_rng(0)
    w = rng.normal(size=p.buckets)
    text = "aa aa b ccccc aa"
    at, share = quality_classifier.text_features(text, p)
    ids = []
    words = text.encode().split()
    for i, x in enumerate(words):
        ids += quality_classifier.word_features([x], p)[0].tolist()
        if i and words[i - 1] == x:
            ids.append(quality_classifier._same_bucket(p))
    assert abs(w[ids].mean() - share @ w[at]) < 1e-6
    both = quality_classifier.word_features([b"aa", b"ccccc"], p)
    assert both[1].tolist() == [1 + 3 + 2 + 1, 1 + 6 + 5 + 4]
    some = [b"aa", b"ccccc", b"", b"x" * 40, "ö".encode()]
    sums, counts = quality_classifier.word_sums(some, w, p)
    for x, s, n in zip(some, sums, counts):
        ids = quality_classifier.word_features([x], p)[0]
        assert abs(w[ids].sum() - s) < 1e-9 and len(ids) == n


def brute_base(text):
    words = text.encode().split()
    marked = set()
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                marked |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(marked))


def test_line_counts_equal_brute_force(spark, corpus, rows, labelled):
    rng = random.Random(4)
    extra = []
    for i in range(200, 230):
        part = prose(rng, 12)
        extra.append((i, "\n".join(rng.choice([part, prose(rng, 9), "a|b <c> #", "", " ", part.replace(" ", "\n")])
                                   for _ in range(12))))
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = line_quality.decide(docs, labelled[1]).collect()
    want = sorted(str((i, *brute_base(t or ""))) for i, t in [(i, t) for i, t, _ in rows] + extra)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_line_field_learns(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in line_quality.decide(docs, labels).collect()}
    right = sum(r.kept == (i % 3 > 0) for i, r in got.items() if not r.base_failed)
    assert right >= 0.95 * sum(not r.base_failed for r in got.values())
    assert line_quality.decide(docs.where("false"), labels).collect() == []
    assert all(r.kept != r.base_failed for r in line_quality.decide(docs, labels.where("false")).collect())


def test_lines_change_state_within_a_document(labelled):
    """Junk lines planted in good documents are marked; a clean line beside them may be too, as the
    training documents marked 0 hold clean lines."""
    field = line_quality.fit(*labelled)
    rng, junk_marked, clean_marked, n_clean = random.Random(31), 0, 0, 0
    for _ in range(100):
        lines = [prose(rng, rng.randrange(5, 25)).rstrip(",.") + "." for _ in range(rng.randrange(3, 9))]
        junk = [" ".join(w + "###" for w in prose(rng, rng.randrange(5, 25)).split()) for _ in range(2)]
        at = rng.randrange(len(lines) + 1)
        mixed = lines[:at] + junk + lines[at:]
        got = line_quality.viterbi(line_quality.line_features(mixed), field)
        junk_marked += int((~got[at:at + 2]).sum())
        clean_marked += int((~got).sum() - (~got[at:at + 2]).sum())
        n_clean += len(lines)
        share = line_quality.judge("\n".join(mixed), field)[6]
        words = np.array([len(x.split()) for x in mixed])
        assert abs(share - words[got].sum() / words.sum()) < 1e-12
        assert line_quality.viterbi(line_quality.line_features(lines), field).all()
    assert junk_marked >= 195 and clean_marked <= 0.06 * n_clean, (junk_marked, clean_marked, n_clean)


def test_mixtures():
    rng = np.random.default_rng(0)
    x, other = np.arange(6.0).reshape(3, 2), -1 - np.arange(40.0).reshape(20, 2)
    for _ in range(50):
        lines, state = line_quality._mix(x, 1, other, rng)
        assert lines[state == 1].tolist() == x.tolist() and 1 <= (state == 0).sum() <= line_quality.MIXED
        run = lines[state == 0]
        assert (run < 0).all() and (np.diff(run[:, 0]) == -2).all() and np.abs(np.diff(state)).sum() <= 2


def test_line_words_are_cut_at_the_six_spaces():
    f = line_quality.line_features(["a\u00a0b c\x1cd"])  # two words
    assert f[0, 2] == 1 and line_quality.judge("a\u00a0b c\x1cd", line_quality.Field(np.zeros((2, 18)), np.zeros((2, 2))))[0] == 2


def test_viterbi_and_expectations_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        x = rng.integers(0, 2, (n, line_quality.N_FEATURES)).astype(float)
        f = line_quality.Field(rng.normal(size=(2, line_quality.N_FEATURES)), rng.normal(size=(2, 2)))
        u = x @ f.emit.T
        paths = list(itertools.product((0, 1), repeat=n))
        score = np.array([sum(u[i, s] for i, s in enumerate(p)) + sum(f.move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert line_quality.viterbi(x, f).astype(int).tolist() == list(paths[int(score.argmax())])
        prob = np.exp(score) / np.exp(score).sum()
        states, moves = line_quality._expected(u, f.move)
        assert np.allclose(states[:, 1], [sum(q for p, q in zip(paths, prob) if p[i]) for i in range(n)])
        assert np.allclose(moves[0, 1], sum(q * sum(a == 0 and b == 1 for a, b in zip(p, p[1:])) for p, q in zip(paths, prob)))


def brute_count(word, starts, more):
    i = n = 0
    while i < len(word):
        for j in range(min(len(word), i + 64), i, -1):  # no piece is longer
            if word[i:j] in (more if i else starts):
                break
        else:
            return -1
        i, n = j, n + 1
    return n


def test_wordpiece_automaton_equals_greedy_matching():
    rng = random.Random(3)
    for _ in range(40):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
        starts, more = {piece() for _ in range(rng.randrange(6))}, {piece() for _ in range(rng.randrange(6))}
        a = wordpiece_count.Automaton(starts, more)
        for _ in range(200):
            w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
            assert a.count(w) == brute_count(w, starts, more), (w, starts, more)


def test_wordpiece_counts(corpus, rows):
    starts, more = map(set, wordpiece_count.vocabulary())
    got = wordpiece_count.counts(corpus).collect()
    want = []
    for i, t, _ in rows:
        each = [brute_count(w.decode(), starts, more) for w in (t or "").encode().split()]
        want.append(str((i, len(each), sum(1 if x < 0 else x for x in each), each.count(-1))))
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert {r.n_tokens == r.n_words == r.n_unknown for r in wordpiece_count.counts(corpus, ([], [])).collect()} == {True}


def test_sentencepiece_shortest_path_and_round_trip(corpus, rows):
    import sentencepiece
    p = sentencepiece_fst.load()
    t = sentencepiece_fst.Transducer(p)

    def cheapest(s):
        best = [0.0] + [float("inf")] * len(s)
        for i in range(len(s)):
            if s[i] not in p.text:
                best[i + 1] = min(best[i + 1], best[i] + sum(p.weight[x] for x in t.fallback(s[i])))
            for j in range(i + 1, min(len(s), i + 64) + 1):
                if s[i:j] in p.text:
                    best[j] = min(best[j], best[i] + p.weight[p.text[s[i:j]]])
        return best[-1]

    texts = [x for _, x, _ in rows if x is not None]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert t.decode(ids.tolist()) == text == sp.decode(ids.tolist())
        if len(text) < 3000:
            parts = t.normalise(text)
            want = sum(map(cheapest, parts)) + (len(parts) - 1) * sum(p.weight[x] for x in t.fallback("▁")) if parts else 0
            assert abs(sum(p.weight[i] for i in ids) - want) < 1e-6
            assert ids.tolist() == [i for n, part in enumerate(parts) for i in
                                    (t.fallback("▁") if n else []) + t.shortest(part)]
    got = sentencepiece_fst.digest(corpus).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    tokens = sentencepiece_fst.encoded(corpus)
    assert [c for c in tokens.columns if c not in ("n_tokens", "ids")] == [c for c in corpus.columns if c != "text"]
    back = sorted(str((r.doc_id, r.text)) for r in sentencepiece_fst.decoded(tokens).collect())
    assert back == sorted(str((i, x)) for i, x, _ in rows)
    assert sentencepiece_fst.encoded(corpus.where("false")).collect() == []
