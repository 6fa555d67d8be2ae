"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix holds ``SHARE_NUM / SHARE_DEN`` of all words. Sources in code point
order weigh 5, 2, 1, repeating; a source's target stops at ``REPEATS`` times
its size and the excess goes to the others by weight. The mix is dealt in
blocks of ``BLOCK`` words: the highest quotients target / (2k + 1) give each
source an integer number of blocks, and again each shard of a source its part.
Shards are about ``SHARD_WORDS`` words of a source, chosen by a seeded hash, so
a source of any size is cut into shards of one size. In a shard the documents
stand in seeded order on an axis of words; the quota is laid over it as whole
passes and one seeded cyclic run of blocks. So all but the two documents at
the ends of a run are taken whole or not at all, and what is taken of a
document follows from its place on the axis.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; documents without words are in no mix; an empty table gives no rows; sources without words have target
0; rows with equal or null ids are separate documents.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2
REPEATS = 2
BLOCK = 16
SHARD_WORDS = 2_000_000
SEED = "mix-1"


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1); of equals the first comes first."""
    v = np.asarray(votes, float)
    if not len(v) or v.sum() <= 0:
        return [0] * len(v)
    s = np.floor(v / (v.sum() / seats) + 0.5).astype(np.int64) if seats else np.zeros(len(v), np.int64)
    while s.sum() < seats:
        s[int(np.argmax(v / (2 * s + 1)))] += 1
    while s.sum() > seats:
        last = np.where(s > 0, v / np.maximum(2 * s - 1, 1), np.inf)[::-1]
        s[len(v) - 1 - int(np.argmin(last))] -= 1
    return s.tolist()


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(SHARE_NUM, SHARE_DEN)) -> list[float]:
    """Words of each source: least(cap, level * weight), the level filling the share of all words."""
    caps = [REPEATS * s for s in sizes]
    left, weight = share * sum(sizes), sum(weights)
    level = 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(caps[i], weights[i]), i)):
        level = float(left / weight)
        if left * weights[i] <= caps[i] * weight:
            break
        left -= caps[i]
        weight -= weights[i]
    return [min(float(c), level * w) for c, w in zip(caps, weights, strict=True)]


def _plan(g: pd.DataFrame) -> pd.DataFrame:
    """Targets and block quotas; one row a source."""
    g = g.sort_values("place")
    sizes = [int(x) for x in g["source_size"]]
    t = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(g))])
    return g.assign(target=t, blocks=sainte_lague(t, SHARE_NUM * sum(sizes) // (SHARE_DEN * BLOCK)))


def _deal(g: pd.DataFrame) -> pd.DataFrame:
    """Quotas of the shards of one source; one row for SHARD_WORDS words."""
    g = g.sort_values("shard")
    return g.assign(quota=sainte_lague([float(x) for x in g["words"]], int(g["blocks"].iloc[0])))[
        ["place", "shard", "words", "quota"]]


def seeded(*parts: Column | str) -> Column:
    """A number of 60 bits from the md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-"))
                                          for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _within(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def _placed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """docs with size, source_size, target, start on the shard's axis, whole passes and the ends of the run."""
    sized = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    stats = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("src").isNull(), "src")) - 1  # one row a source
    plan = written(stats.withColumn("place", place).groupBy(F.lit("")).applyInPandas(
        _plan, "src string, source_size long, place int, target double, blocks long"))
    x = sized.join(plan, sized.src.eqNullSafe(plan.src)).drop(plan.src)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
    x = x.withColumn("shard", F.pmod(seeded(F.lit("shard"), "id", "size"), shards))
    quotas = written(x.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.min("blocks").alias("blocks"))
                     .groupBy("place").applyInPandas(_deal, "place int, shard long, words long, quota long"))
    order = Window.partitionBy("place", "shard").orderBy(seeded(F.lit("place"), "id"), "id", "size")
    x = x.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("start", F.coalesce("start", F.lit(0))).drop("blocks").join(quotas, ["place", "shard"])
    words, take = F.col("words"), F.least(F.col("quota") * BLOCK, REPEATS * F.col("words"))
    n_blocks = F.ceil(words / BLOCK)
    x = (x.withColumn("passes", F.when(words > 0, F.floor(take / F.greatest(words, F.lit(1)))).otherwise(0))
         .withColumn("run", F.floor((take - F.col("passes") * words) / BLOCK + F.lit(0.5)))
         .withColumn("first", F.pmod(seeded(F.lit("first"), "place", "shard"), F.greatest(n_blocks, F.lit(1))))
         .withColumn("low", F.col("first") * BLOCK)
         .withColumn("high", F.least(words, (F.col("first") + F.col("run")) * BLOCK))
         # what goes past the end of the axis starts it again
         .withColumn("wrap", F.greatest(F.lit(0), (F.col("first") + F.col("run") - n_blocks) * BLOCK)))
    end = F.col("start") + F.col("size")
    return (x.withColumn("late", _within(F.col("start"), end, F.col("low"), F.col("high")))
            .withColumn("early", _within(F.col("start"), end, F.lit(0), F.least("wrap", "low")))
            .withColumn("taken", F.col("passes") * F.col("size") + F.col("late") + F.col("early")))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, source, text)."""
    return _placed(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix, with the columns of docs: a row for each whole or partial copy that it takes.

    A partial copy (at the ends of a run) has its words joined by one space.
    """
    x = _placed(docs, docs.columns)
    words = F.expr(f"regexp_extract_all(row.text, '{WORD}', 0)".replace("\\", "\\\\"))
    begin = F.greatest(F.lit(0), F.col("low") - F.col("start"))

    def piece(at: Column, n: Column) -> Column:
        return F.array_join(F.slice(words, (at + 1).cast("int"), n.cast("int")), " ")

    run = F.col("late") + F.col("early")
    whole = F.when(F.col("size") > 0, F.col("passes") + F.when(run == F.col("size"), 1).otherwise(0)).otherwise(0)
    part = (run > 0) & (run < F.col("size"))
    copies = F.concat(
        F.array_repeat(F.col("row.text"), whole.cast("int")),
        F.when(part & (F.col("late") > 0), F.array(piece(begin, F.col("late")))).otherwise(F.array().cast("array<string>")),
        F.when(part & (F.col("early") > 0), F.array(piece(F.lit(0), F.col("early")))).otherwise(F.array().cast("array<string>")))
    return x.select("row", F.explode(copies).alias("t")).select(
        *[F.col("t").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


#: DuckDB SQL for ``plan`` over documents.
PLAN_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[1 + place % {len(WEIGHTS)}] AS weight, {REPEATS} * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS k,
        {SHARE_NUM}::DOUBLE / {SHARE_DEN} * (SELECT sum(source_size) FROM s)
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
l AS (SELECT min_by(rest / weights, k) AS level FROM o WHERE rest * weight <= cap * weights),
t AS (SELECT w.*, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM w, l),
q AS (SELECT place, target / (2 * u.k + 1) AS q, u.k FROM t, unnest(range(0, (cap // {BLOCK} + 2)::BIGINT)) AS u(k) WHERE target > 0),
a AS (SELECT place FROM (SELECT place, row_number() OVER (ORDER BY q DESC, place) AS r FROM q)
      WHERE r <= (SELECT {SHARE_NUM} * sum(source_size) // ({SHARE_DEN} * {BLOCK}) FROM s)),
b AS (SELECT t.*, coalesce(n, 0) AS blocks FROM t LEFT JOIN (SELECT place, count(*) AS n FROM a GROUP BY place) USING (place)),
e AS (SELECT d.doc_id, d.size, b.*, ('0x' || substr(md5('{SEED}:shard:' || coalesce(doc_id::VARCHAR, '-') || ':' || size), 1, 15))::BIGINT
        % greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shard FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
h AS (SELECT place, shard, sum(size)::BIGINT AS words, min(blocks) AS blocks FROM e GROUP BY place, shard),
hq AS (SELECT place, shard, words, blocks, row_number() OVER (PARTITION BY place ORDER BY words / (2 * u.k + 1) DESC, shard) AS r
       FROM h, unnest(range(0, (2 * words // {BLOCK} + 2)::BIGINT)) AS u(k)),
f AS (SELECT h.place, h.shard, h.words, coalesce(n, 0) AS quota FROM h LEFT JOIN
        (SELECT place, shard, count(*) AS n FROM hq WHERE r <= blocks GROUP BY place, shard) USING (place, shard)),
g AS (SELECT *, least(quota * {BLOCK}, {REPEATS} * words) AS take, ceil(words / {BLOCK})::BIGINT AS n_blocks FROM f),
p AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes,
        ('0x' || substr(md5('{SEED}:first:' || place || ':' || shard), 1, 15))::BIGINT % greatest(n_blocks, 1) AS first FROM g),
r AS (SELECT *, floor((take - passes * words) / {BLOCK} + 0.5)::BIGINT AS run FROM p),
x AS (SELECT e.doc_id, e.size, e.source_size, e.target, r.*, coalesce(sum(e.size) OVER (PARTITION BY e.place, e.shard ORDER BY
        ('0x' || substr(md5('{SEED}:place:' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT, e.doc_id, e.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e JOIN r ON e.place = r.place AND e.shard = r.shard)
SELECT doc_id, size, source_size, target, (passes * size
  + greatest(0, least(start + size, least(words, (first + run) * {BLOCK})) - greatest(start, first * {BLOCK}))
  + greatest(0, least(start + size, least(greatest(0, (first + run - n_blocks) * {BLOCK}), first * {BLOCK})) - start))::BIGINT AS taken
FROM x
"""
