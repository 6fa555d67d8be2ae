"""Agglomerative clustering (M6): ward, complete, average, single.

The O(n^2) original is re-aimed: Spark K-means summarises the distinct points
as ``max_micro`` weighted micro-clusters and the merge tree of those summaries
is built in one task (a group of at most ``max_micro`` rows) with the
nearest-neighbour-chain algorithm and Lance-Williams updates. Ward on weighted
centres is exact for the merge criterion; complete, average and single linkage
on centres are approximations.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import impute_median

LINKAGES = ("ward", "complete", "average", "single")


def merge_tree(centres: np.ndarray, weights: np.ndarray, linkage: str = "ward"):
    """All m - 1 merges as (height, a, b) of the NN-chain algorithm."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage: {linkage}")
    m = len(centres)
    diff = centres[:, None, :] - centres[None, :, :]
    sq = (diff * diff).sum(axis=2)
    size = weights.astype(float).copy()
    if linkage == "ward":
        D = size[:, None] * size[None, :] / (size[:, None] + size[None, :]) * sq
    else:
        D = np.sqrt(sq)
    np.fill_diagonal(D, np.inf)
    active = np.ones(m, dtype=bool)
    merges = []
    chain: list = []
    while active.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        a = chain[-1]
        row = np.where(active, D[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))
        if len(chain) >= 2 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) >= 2 and b == chain[-2]:
            chain.pop()
            chain.pop()
            h = D[a, b]
            i, j = min(a, b), max(a, b)
            ni, nj = size[i], size[j]
            others = active.copy()
            others[[i, j]] = False
            nl = size[others]
            if linkage == "ward":
                new = ((ni + nl) * D[i, others] + (nj + nl) * D[j, others] - nl * h) / (ni + nj + nl)
            elif linkage == "complete":
                new = np.maximum(D[i, others], D[j, others])
            elif linkage == "single":
                new = np.minimum(D[i, others], D[j, others])
            else:
                new = (ni * D[i, others] + nj * D[j, others]) / (ni + nj)
            D[i, others] = new
            D[others, i] = new
            D[j, :] = np.inf
            D[:, j] = np.inf
            active[j] = False
            size[i] = ni + nj
            merges.append((float(h), i, j))
        else:
            chain.append(b)
    return merges


def cut(merges, m: int, n_clusters: int) -> np.ndarray:
    """Apply the lowest merges until ``n_clusters`` remain; label per summary."""
    parent = np.arange(m)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    k = m
    for h, a, b in sorted(merges, key=lambda t: t[0]):
        if k <= n_clusters:
            break
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            k -= 1
    return np.array([find(i) for i in range(m)])


def hierarchical(df: DataFrame, xs, n_clusters: int = 4, linkage: str = "ward", id_col: str = "customer_id",
                 max_micro: int = 1000, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(id, cluster) per row; clusters numbered by size, largest first.

    One method at every size: Spark K-means summarises the distinct points,
    weighted by their counts, in ``max_micro`` centres, and one task merges
    those weighted centres. With at most ``max_micro`` distinct points every
    point is its own centre, so the result is that of plain agglomeration.
    Missing values are filled with the column median first.
    """
    pts = impute_median(df.select(id_col, *xs), list(xs))
    distinct = pts.groupBy(*xs).agg(F.count(F.lit(1)).cast("double").alias("__w"))
    vec = VectorAssembler(inputCols=list(xs), outputCol="__v").transform(distinct)
    # random initialisation takes every distinct point when there are no more than max_micro
    km = KMeans(k=max_micro, seed=seed, featuresCol="__v", weightCol="__w", predictionCol="__m", maxIter=max_iter,
                initMode="random").fit(vec)
    key = km.transform(vec).select(*xs, "__w", F.col("__m").cast("long").alias("__m"))
    d = range(len(xs))
    sums = key.groupBy("__m").agg(F.sum("__w").alias("w"), *[(F.sum(F.col(x) * F.col("__w")) / F.sum("__w")).alias(f"c{i}")
                                                          for i, x in enumerate(xs)])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([f"c{i}" for i in d]).reset_index(drop=True)
        if len(g) < n_clusters:
            raise ValueError("fewer distinct points than clusters")
        w = g["w"].to_numpy(float)
        roots = cut(merge_tree(g[[f"c{i}" for i in d]].to_numpy(float), w, linkage), len(g), n_clusters)
        total = pd.Series(w).groupby(roots).sum()
        order = sorted(total.index, key=lambda r: (-total[r], r))
        return pd.DataFrame({"__m": g["__m"], "cluster": [order.index(r) for r in roots]})

    # at most max_micro rows meet in the one group
    named = sums.groupBy(F.lit("")).applyInPandas(merge, "__m long, cluster long")
    labels = key.join(named, "__m").select(*xs, "cluster")
    return pts.join(labels, list(xs)).select(id_col, "cluster")
