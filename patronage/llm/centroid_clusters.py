"""Exact centroid clustering over dictionary-encoded subvectors.

Components become integers (floor of ``SCALE`` times the value), so that every
distance and sum is exact. Vectors are cut into blocks of ``WIDTH`` dimensions;
a chunk of up to ``CHUNK`` vectors is written once as one row: for each block
the distinct subvectors of the chunk and each vector's code. That loses
nothing. A round computes the distance of each distinct subvector to each
centroid's block once, adds the partial distances up by code, and takes the
nearest centroid; sums of a cluster come from counts of (cluster, code), again
once for each distinct subvector.

A task returns at most one row for each centroid, which Spark adds up; the
driver holds the centroids only. Rounds read the written chunks, nothing else is
shuffled or kept, so a hot cluster is no hot task.

Defined cases: vectors that are null, have another number of components, or
hold null or non-finite ones are left out, and so are those with a component
beyond ``BOUND``, whose distances a long might not hold; fewer vectors than
centroids give fewer centroids; no vectors give no rows; a null vec_id is
hashed as an empty one; rows that repeat a vec_id are vectors of their own,
ordered by their components where hashes tie; other columns are not looked at.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

DIMENSIONS, CENTROIDS, ROUNDS = 64, 8, 10
SCALE, SEED = 1024, 3
#: Largest absolute component: scaled by 1024 it is 2^27, and 64 squared differences stay below 2^63.
BOUND = 131_072.0
WIDTH, CHUNK = 1, 8192


def usable(dimensions: int = DIMENSIONS) -> Column:
    x = F.col("embedding")
    return x.isNotNull() & (F.size(x) == dimensions) & F.forall(
        x, lambda v: F.coalesce(F.abs(v.cast("double")) <= BOUND, F.lit(False)))  # NaN is larger than any number


def encode(v: np.ndarray, width: int) -> dict:
    """The dictionaries and codes of a chunk of integer vectors (rows)."""
    sizes, entries, codes = [], [], []
    for at in range(0, v.shape[1], width):
        own, code = np.unique(v[:, at:at + width], axis=0, return_inverse=True)
        sizes.append(len(own))
        entries.append(own.ravel())
        codes.append(code.ravel().astype(np.uint16 if CHUNK <= 65536 else np.int32))
    return {"n": len(v), "sizes": np.array(sizes, np.int32).tobytes(),
            "entries": np.concatenate(entries).astype(np.int64).tobytes(), "codes": np.concatenate(codes).tobytes()}


def blocks(row, dimensions: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, code of each vector) of each block of an encoded chunk."""
    sizes, entries = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["entries"], np.int64)
    codes = np.frombuffer(row["codes"], np.uint16 if CHUNK <= 65536 else np.int32).reshape(len(sizes), row["n"])
    at = 0
    for b, first in enumerate(range(0, dimensions, width)):
        w = min(width, dimensions - first)
        yield first, entries[at:at + sizes[b] * w].reshape(sizes[b], w), codes[b]
        at += sizes[b] * w


def nearest(row, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector of a chunk; of equals the smaller number."""
    total = np.zeros((row["n"], len(centroids)), np.int64)
    for first, own, code in blocks(row, centroids.shape[1], width):
        part = ((own[:, None, :] - centroids[None, :, first:first + own.shape[1]]) ** 2).sum(axis=2)
        total += part[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _chunks(dimensions: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                x = b.iloc[at:at + CHUNK]
                v = np.floor(SCALE * np.stack(x["embedding"].to_numpy()).astype(np.float64)).astype(np.int64)
                yield pd.DataFrame([{"ids": x["id"].to_numpy(np.int64).tobytes(),
                                     "no_id": x["no_id"].to_numpy(bool).tobytes(), **encode(v, width)}])
    return run


def _sums(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            for row in b.to_dict("records"):
                cluster, _ = nearest(row, centroids, width)
                n += np.bincount(cluster, minlength=k)
                for first, own, code in blocks(row, d, width):
                    times = np.bincount(cluster * len(own) + code, minlength=k * len(own)).reshape(k, len(own))
                    sums[:, first:first + own.shape[1]] += times @ own
        full = np.flatnonzero(n)
        if len(full):
            yield pd.DataFrame({"cluster": full.astype(np.int32), "n": n[full], "sums": [s.tolist() for s in sums[full]]})
    return run


def _assign(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                cluster, distance = nearest(row, centroids, width)
                ids = pd.Series(np.frombuffer(row["ids"], np.int64), dtype="Int64")
                yield pd.DataFrame({"vec_id": ids.mask(np.frombuffer(row["no_id"], bool)),
                                    "cluster": cluster.astype(np.int32), "distance": distance})
    return run


def advance(chunks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each non-empty cluster, exactly."""
    per_task = chunks.mapInPandas(_sums(centroids, width), "cluster int, n long, sums array<long>")
    d = centroids.shape[1]
    out = centroids.copy()
    for r in per_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
            *[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums")).collect():  # one row a centroid
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of embeddings."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    out = "vec_id long, cluster int, distance long"
    try:
        kept = embeddings.where(usable(dimensions)).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = kept.select(h.alias("h"), "embedding").orderBy("h", "embedding").limit(centroids).collect()
        c = np.floor(SCALE * np.array([r["embedding"] for r in first], float).reshape(-1, dimensions)).astype(np.int64)
        if not len(c):
            empty = spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
            return empty
        named = kept.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.isnull("vec_id").alias("no_id"), "embedding")
        chunks = scratch.keep(named.mapInPandas(
            _chunks(dimensions, width), "ids binary, no_id binary, n int, sizes binary, entries binary, codes binary"))
        for _ in range(rounds):
            c = advance(chunks, c, width)
        dealt = scratch.keep(chunks.mapInPandas(_assign(c, width), out))
        sums = {r["cluster"]: r["s"] for r in dealt.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
        facts = spark.createDataFrame([(i, s, sum(sums.values()), digest[i]) for i, s in sums.items()],
                                      "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return written(dealt.join(F.broadcast(facts), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
    finally:
        scratch.clear()


def cluster_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """DuckDB SQL: a row for each (vector, dimension), a chain of rounds."""
    ctes = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dimensions}
  AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y) AND abs(y::DOUBLE) <= {BOUND})) = {dimensions}),
x AS MATERIALIZED (SELECT i, j, floor({SCALE} * e[j]::DOUBLE)::BIGINT AS x FROM (SELECT i, e, unnest(range(1, {dimensions + 1})) AS j FROM v)),
s AS (SELECT i, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, j, x FROM x JOIN s USING (i) WHERE k < {centroids})"""]
    for r in range(rounds + 1):
        ctes.append(f"""
d{r} AS (SELECT x.i, c.k, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{r} c USING (j) GROUP BY x.i, c.k),
a{r} AS MATERIALIZED (SELECT i, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1)""")
        if r < rounds:
            ctes.append(f"""
m{r} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (i) GROUP BY k, j),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(((s - (s % n + n) % n) // n)::BIGINT, c.x) AS x
  FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.j = m.j)""")
    return f"""WITH {",".join(ctes)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} a JOIN v USING (i) JOIN h ON a.k = h.k
"""
