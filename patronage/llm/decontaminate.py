"""Benchmark decontamination with a broadcast set of test n-grams.

DataFrame functions only. A window is ``WINDOW`` consecutive words of a
benchmark item, or a whole item of fewer. A window of L words holds, wherever
it stands in a document, one whole chunk of the document cut every c words
from its start, if 2c - 1 <= L. So a document is scanned in chunks of
c = (L + 1) // 2 words that do not overlap, each word once for a length of
chunk, against the set of hashes of all c-grams of the windows. The set is
broadcast if it has at most ``BROADCAST`` entries (its rows are counted
first), and joined by a shuffle beyond. A chunk that is in the set leaves the
scan with the words around it; the windows that may hold the chunk are then
compared as strings, so a hash alone never decides.

The occurrences of a document's windows become spans of words. Items are
looked up through classes: windows of the same items are one class, documents
of the same classes are one set, and the items of a set are joined once, so a
passage that stands in many items and many documents is not multiplied out.

Defined cases: a null or empty text, or one without words, has no words and no
windows; an item without words has none; a null item_id marks words, but is no
item; rows that repeat an item_id are one item; rows that repeat a doc_id, and
null ones, are documents of their own; an empty benchmark hits nothing; other
columns are not looked at.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

WINDOW = 10
#: Most chunk hashes that are broadcast: a long each, some 50 MB as a hash table.
BROADCAST = 1_000_000

_LETTERS = set(string.ascii_letters + string.digits)
_CUT = "".join(chr(i) for i in range(128) if chr(i) not in _LETTERS)
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _CUT,
                        string.ascii_lowercase + " " * len(_CUT))
    return F.array_remove(F.split(plain, " "), "")


def chunk(length: int) -> int:
    return (length + 1) // 2


def _chunks(words_: Column, n: Column, c: int, step: int) -> Column:
    """(p, c, h) of the chunks that begin at 1, 1 + step, ..."""
    return F.transform(_starts(n, c, step), lambda p: F.struct(
        p.alias("p"), F.lit(c).alias("c"), F.xxhash64(F.lit(c), F.slice(words_, p, F.lit(c))).alias("h")))


def _starts(n: Column, length: int, step: int = 1) -> Column:
    """1, 1 + step, ... while ``length`` words are left; an empty array if there are none."""
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, window as text, item) of every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")) \
        .withColumn("n", F.size("w")).where("n > 0").withColumn("length", F.least("n", F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.col("n") - F.col("length") + 1))
    return items.select("item", "w", "length", at.alias("i")) \
        .select("item", "length", F.array_join(F.slice("w", F.col("i"), F.col("length")), " ").alias("window"))


def _chunk_set(known: DataFrame, lengths: list[int]) -> DataFrame:
    """(h) of every chunk-long gram of the windows."""
    parts = F.split("window", " ")
    grams = F.array().cast("array<bigint>")
    for length in lengths:
        own = _chunks(parts, F.lit(length), chunk(length), 1)
        grams = F.when(F.col("length") == length, own["h"]).otherwise(grams)
    return known.select(F.explode(grams).alias("h")).distinct()


def _scan(docs: DataFrame, keys: DataFrame, small: bool, sizes: list[int]) -> DataFrame:
    """(row, doc_id, n_words, p, c, around): one row with p = 0 a document, and one for each chunk of the set."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w")) \
        .withColumn("n_words", F.size("w"))
    first = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("c"), F.xxhash64("row").alias("h")))
    chunks = [_chunks(F.col("w"), F.col("n_words"), c, c) for c in sizes]
    every = rows.withColumn("x", F.concat(first, *chunks)).select("row", "doc_id", "n_words", "w", F.explode("x").alias("x")) \
        .select("row", "doc_id", "n_words", "w", "x.p", "x.c", "x.h")
    around = F.when(F.col("p") > 0, F.slice("w", F.greatest(F.col("p") - F.col("c"), F.lit(1)), 3 * F.col("c")))
    cols = ["row", "doc_id", "n_words", "p", "c"]
    marked = keys.withColumn("known", F.lit(True))
    if small:
        return every.join(F.broadcast(marked), "h", "left").where("p = 0 OR known").select(*cols, around.alias("around"))
    return every.select(*cols, around.alias("around"), "h").join(marked, "h", "left").where("p = 0 OR known") \
        .select(*cols, "around")


def _stretches(first: Column, last: Column, begins: Column, length: int) -> Column:
    """(i, e, window) of the ``length`` words from each of first .. last; ``around`` begins at ``begins``."""
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct(
        i.alias("i"), (i + (length - 1)).alias("e"),
        F.array_join(F.slice("around", i - begins + 1, F.lit(length)), " ").alias("window"))))


def _places(found: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, i, e, window): the stretches i .. e of a document that hold a known chunk and may be a window."""
    lo = F.greatest(F.col("p") - F.col("c"), F.lit(1))
    tries = F.array().cast("array<struct<i:int,e:int,window:string>>")
    for length in lengths:
        c = chunk(length)
        own = _stretches(F.greatest(F.col("p") - (length - c), F.lit(1)),
                         F.least(F.col("p"), F.col("n_words") - length + 1), lo, length)
        tries = F.when((F.col("c") == c) & own.isNotNull(), F.concat(tries, own)).otherwise(tries)
    return found.select("row", F.explode(tries).alias("x")).select("row", "x.i", "x.e", "x.window")


def _covered(spans: Column) -> Column:
    """Words under the sorted spans (i, e)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["e"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["end"], s["i"] - 1))).alias("n")), lambda acc: acc["n"])


def found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames: all rows (row, doc_id, n_words); their spans (row, spans, classes); items (class, items)."""
    known = scratch.keep(windows(benchmark, window).groupBy("length", "window").agg(
        F.array_sort(F.collect_set("item")).alias("items")).withColumn("class", F.sha2(F.to_json("items"), 256)))
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # at most ``window`` rows
    keys = scratch.keep(_chunk_set(known, lengths))
    scanned = scratch.keep(_scan(docs, keys, keys.count() <= BROADCAST, sorted({chunk(x) for x in lengths})))
    hits = _places(scanned.where("p > 0"), lengths).join(known.select("window", "class"), "window")
    spans = scratch.keep(hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("i", "e"))).alias("spans"),
        F.array_sort(F.collect_set("class")).alias("classes")))
    return scanned.where("p = 0").select("row", "doc_id", "n_words"), spans, known.select("class", "items").distinct()


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    try:
        every, spans, items = found(docs, benchmark, scratch, window)
        sets = spans.select("classes").distinct().select("classes", F.explode("classes").alias("class")) \
            .join(items, "class").groupBy("classes") \
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")) \
            .select("classes", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        hit = spans.join(sets, "classes").select("row", _covered(F.col("spans")).alias("n_hit"), "n_items", "items_sha256")
        zero = F.lit(0).cast("long")
        return written(every.join(hit, "row", "left").select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))
    finally:
        scratch.clear()


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW) -> DataFrame:
    """docs without what the benchmark holds.

    ``remove="documents"`` drops contaminated rows, ``"spans"`` the hit words
    with the separators before them; n_chars and the like are left as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    scratch = Scratch(docs.sparkSession)
    try:
        at = "__row"
        # one written numbering of the rows serves the scan and the join with their spans
        numbered = scratch.keep(docs.withColumn(at, F.monotonically_increasing_id()))
        every, spans, _ = found(numbered.select(F.col(at).alias("doc_id"), "text"), benchmark, scratch, window)
        spans = every.join(spans, "row").select(F.col("doc_id").alias(at), F.col("spans").alias("__spans"))
        if remove == "documents":
            return written(numbered.join(spans, at, "left_anti").select(*docs.columns))
        pieces = F.regexp_extract_all("text", F.lit(f"{_BETWEEN}{_WORD}"), F.lit(0))
        left = F.filter(pieces, lambda _, k: ~F.exists("__spans", lambda s: (s["i"] <= k + 1) & (k + 1 <= s["e"])))
        text = F.concat(F.array_join(left, ""), F.regexp_extract("text", f"{_BETWEEN}$", 0))
        return written(numbered.join(spans, at, "left").withColumn(
            "text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns))
    finally:
        scratch.clear()


DIGEST_SQL = r"""
WITH
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS MATERIALIZED (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT item, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM w, (SELECT DISTINCT l FROM k) WHERE len(w) >= l)),
m AS MATERIALIZED (SELECT r, i, l, item FROM d JOIN k USING (g, l)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN t ON w.r = t.r
"""
