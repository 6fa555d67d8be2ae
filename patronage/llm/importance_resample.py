"""Importance resampling of documents towards a target distribution.

A text becomes words by one ``bytes.translate`` (``TABLE`` lower-cases A-Z and
blanks the separators of UTF-8) and ``bytes.split``. The crc32 of a run of
words is carried on as the seed of the run that is one word longer, so no
n-gram string is built; crc32 modulo ``BUCKETS`` is the bucket of a feature.
Each task reduces its buckets in a Counter and returns at most ``BUCKETS``
rows, which Spark adds up: one table for the documents, one for the target.
The gain of a bucket is its log ratio in thousandths; a document weighs the
sum of the gains of its features. A Gumbel number from the sha256 of (seed,
doc_id) is added, and of the documents with enough words the highest scores
are drawn: that is sampling without replacement by weight, the same in every
run and at every size.

The driver sees 2 * ``BUCKETS`` sums. Ranks come from a range partitioning on
(score, doc_id); only (doc_id, n_features, weight, score) rows are sorted.

Defined cases: a null or empty text, or one without words, has no features and
weight 0; a null doc_id is hashed as an empty one and comes last among equal
scores; rows that repeat a doc_id are documents of their own, with the same
random number; an empty target or table counts nothing; other columns are not
looked at.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from .common import Scratch, written

BUCKETS, LONGEST = 10_000, 3
SEED, MIN_WORDS, PERCENT = 42, 20, 5

#: A-Z to a-z; 0x00-0x2F, 0x3A-0x40, 0x5B-0x60 and 0x7B-0x7F to blanks; digits, a-z and all bytes from 0x80 stay.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))


def features(text: bytes | None, longest: int = LONGEST) -> tuple[int, list[int]]:
    """The number of words, and the crc32 of every run of 1 to ``longest`` words joined by one space."""
    words = text.translate(TABLE).split() if text else []
    run = list(map(crc32, words))
    out = list(run)
    after = [b" " + w for w in words]
    for _ in range(longest - 1):
        after = after[1:]
        run = list(map(crc32, after, run))
        out += run
    return len(words), out


def _count(longest: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                found = features(text, longest)[1]
                if found:
                    total.update((np.array(found, np.int64) % buckets).tolist())
        yield pd.DataFrame({"bucket": np.fromiter(total.keys(), np.int64, len(total)),
                            "n": np.fromiter(total.values(), np.int64, len(total))})
    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows of texts (text)."""
    per_task = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(
        _count(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    n = float(len(source))
    total_s, total_t = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * total_s / ((s + 1.0) * total_t)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, n, weight = [], [], []
            for text in b["text"]:
                w, found = features(text, longest)
                words.append(w)
                n.append(len(found))
                weight.append(int(gain[np.array(found, np.int64) % len(gain)].sum()) if found else 0)
            yield pd.DataFrame({"id": b["id"], "no_id": b["no_id"], "n_words": words, "n_features": n, "weight": weight})
    return run


def score(docs: DataFrame, target: DataFrame, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
          longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); undrawn rows have a null rank."""
    scratch = Scratch(docs.sparkSession)
    try:
        gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
        own = F.col("doc_id").cast("long")
        rows = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("no_id"),
                           F.col("text").cast("binary").alias("text")) \
            .mapInPandas(_weigh(gain, longest), "id long, no_id boolean, n_words long, n_features long, weight long") \
            .withColumn("doc_id", F.when(~F.col("no_id"), F.col("id"))).drop("id", "no_id")
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        chance = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
        rows = scratch.keep(rows.withColumn("score", F.col("weight") + chance)
                            .withColumn("fit", F.col("n_words") >= min_words).drop("n_words"))
        drawn = percent * rows.where("fit").count() // 100
        ranked = global_rank(rows, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"),
                                    F.col("weight")], "place")
        return written(ranked.select("doc_id", "n_features", "weight", "score",
                                     F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).alias("rank")))
    finally:
        scratch.clear()


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs, all columns; rows of one doc_id come if one of them is drawn."""
    drawn = score(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")


#: crc32 goes bit by bit: 0-255 folds a byte in, -1 shifts.
SCORE_SQL = r"""
WITH
w AS (SELECT 1 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL SELECT 0, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
p AS (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) x(n) WHERE len(w) >= n),
f AS MATERIALIZED (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS k FROM p GROUP BY ALL),
v AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(strlen(f)),
        lambda i: [('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT f FROM f)),
s AS (SELECT x.bucket, coalesce(sum(k) FILTER (WHERE side = 1), 0)::DOUBLE AS s,
        coalesce(sum(k) FILTER (WHERE side = 0), 0)::DOUBLE AS t
      FROM (SELECT unnest(range(10000)) AS bucket) x LEFT JOIN (SELECT * FROM f JOIN v USING (f)) y ON x.bucket = y.bucket GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM s),
d AS (SELECT r, sum(k)::BIGINT AS n, sum(k * gain)::BIGINT AS weight FROM f JOIN v USING (f) JOIN g USING (bucket)
      WHERE side = 1 GROUP BY r),
z AS (SELECT doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d ON w.r = d.r WHERE side = 1),
k AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS place,
        5 * count(*) FILTER (WHERE fit) OVER () // 100 AS drawn FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM k
"""
