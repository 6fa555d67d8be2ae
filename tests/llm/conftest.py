import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "ren", "sol", "ver", "ös") for b in ("ta", "be", "ri", "no", "s", "mund")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", ".", ",")) for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "edit%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, hard cases, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    rows, passage = [], prose(rng, 60)
    for i in range(60):
        rows.append((i, prose(rng, rng.randrange(30, 200)), "en", "s%d" % (i % 4)))
    for i in range(60, 80):
        rows.append((i, rows[i - 60][1], "de", "s0"))
    for i in range(80, 110):
        rows.append((i, edited(rng, rows[i - 80][1], rng.randrange(1, 4)), "fr", None))
    for i in range(110, 118):
        rows.append((i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40), None, "s1"))
    rows += [(118, "", "en", "s2"), (119, None, "en", "s2"), (120, " \t\n", None, None), (121, "one", "en", "s3"),
             (122, "ONE", "en", "s3"), (123, prose(rng, 20000), "en", "s2"), (124, "x" * 150000, "en", "s2"),
             (125, "ab " * 400, "en", "s2"), (None, prose(rng, 50), "en", "s1"), (None, None, None, None)]
    rows += [rows[3], rows[3], (126, "naïve ▁ \x00\x1f 日本語 🙂  double  space ", "en", "s3")]
    docs = spark.createDataFrame([r + (len(r[1]) if r[1] is not None else None, 0.5, "z", 7, "f") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long,"
                                 "score double, row string, rid long, found string")
    return docs.repartition(5).cache()


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text, r.source) for r in corpus.select("doc_id", "text", "source").collect()]
