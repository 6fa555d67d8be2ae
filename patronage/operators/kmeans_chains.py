"""K-means from many starts and for many k side by side (M2, M3).

A chain is one (k, seed). All chains advance together: one scan of the points an
iteration, in which a task adds up count, sum and cost of every (chain, cluster)
and returns that many rows, which Spark adds up again. The driver holds centres
only, k rows a chain. Chains that moved by no more than ``tol`` leave.

Starts follow k-means||: a first point by least hash, then ``STEPS`` rounds in
which a point becomes a candidate with probability 2k times its share of the
cost, weights by one more scan, and k-means++ over the weighted candidates (about
4k a chain). Draws are hashes of the row's id and values, the seed and the round, so
reruns and lost executors draw the same; candidates of equal value are one.

Fewer distinct points than k give fewer centres; no points give none.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 2
#: Further rounds, each drawing four times as often, for chains that still have fewer candidates than k.
EXTRA = 8
Spec = tuple[int, int]  # k, seed


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes and a salt."""
    x = h.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            x = x ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / float(1 << 53)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every point (ties: the first) and the squared distance to it."""
    near = np.argmin((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T), axis=1)
    diff = x - centres[near]
    return near, np.einsum("ij,ij->i", diff, diff)


def _scan(points: DataFrame, features: str, chains: dict[Spec, np.ndarray]) -> dict[Spec, tuple]:
    """(counts, sums, cost) of the clusters of every chain, in one scan."""
    specs = list(chains)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            for i, s in enumerate(specs):
                c = chains[s]
                near, d2 = _nearest(x, c)
                now = np.column_stack([np.bincount(near, minlength=len(c)), np.bincount(near, d2, len(c)),
                                       *[np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])]])
                total[i] = total[i] + now if i in total else now
        rows = [(i, j, row) for i, t in total.items() for j, row in enumerate(t) if row[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))], ["chain", "cluster", "t"])

    width = 2 + len(next(iter(chains.values()))[0])
    rows = points.select(features).mapInArrow(add, "chain int, cluster int, t array<double>") \
        .groupBy("chain", "cluster").agg(*[F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(width)]).collect()
    out = {s: (np.zeros(len(c)), np.zeros_like(c), 0.0) for s, c in chains.items()}
    costs = dict.fromkeys(specs, 0.0)
    for r in sorted(rows, key=lambda r: (r["chain"], r["cluster"])):
        s = specs[r["chain"]]
        out[s][0][r["cluster"]] = r["t0"]
        out[s][1][r["cluster"]] = r[4:]
        costs[s] += r["t1"]
    return {s: (n, t, costs[s]) for s, (n, t, _) in out.items()}


def _moved(counts: np.ndarray, sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one stays where it is."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)


def _drawn(points: DataFrame, features: str, id_col: str, take: Callable) -> DataFrame:
    """(chain, u, x) of the points whose (chain, rows, numbers) ``take(x, hashes)`` picks from a batch."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            found = take(x, b.column(1).to_numpy())
            chain = np.concatenate([np.full(len(r), i, np.int32) for i, r, _ in found])
            if not len(chain):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(chain), pa.array(np.concatenate([u for _, _, u in found])),
                 pa.array([v for _, r, _ in found for v in x[r].tolist()], pa.list_(pa.float64()))], ["chain", "u", "x"])

    return points.select(features, F.xxhash64(id_col, features).alias("h")).mapInArrow(pick, "chain int, u double, x array<double>")


def _by_chain(rows) -> dict[int, list]:
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["chain"], r["x"])):
        out.setdefault(r["chain"], []).append(r["x"])
    return out


def _plus_plus(x: np.ndarray, weights: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means++ and a few rounds over weighted candidates."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.choice(len(x), p=weights / weights.sum())]]
    while len(centres) < k:
        mass = weights * _nearest(x, centres)[1]
        if not mass.sum() > 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=mass / mass.sum())]])
    for _ in range(rounds):
        near, _ = _nearest(x, centres)
        n = np.bincount(near, weights, len(centres))
        sums = np.column_stack([np.bincount(near, weights * x[:, j], len(centres)) for j in range(x.shape[1])])
        centres = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1.0)[:, None], centres)
    return centres


def starts(points: DataFrame, specs: list[Spec], features: str, id_col: str) -> dict[Spec, np.ndarray]:
    """First centres of every chain."""
    specs = list(specs)

    def first(x, h):
        picked = []
        for i, (_, seed) in enumerate(specs):
            u = _uniform(h, seed)
            picked.append((i, np.array([np.argmin(u)]), u[[np.argmin(u)]]))
        return picked

    rows = _drawn(points, features, id_col, first).groupBy("chain").agg(F.min(F.struct("u", "x")).alias("m")) \
        .select("chain", "m.x").collect()
    if not rows:
        return {}
    found = {specs[r["chain"]]: np.array([r["x"]]) for r in rows}
    for step in range(STEPS + EXTRA):
        lacking = {s: c for s, c in found.items() if step < STEPS or len(c) < s[0]}
        if not lacking:
            break
        cost = {s: t[2] for s, t in _scan(points, features, lacking).items()}
        if not any(cost.values()):
            break
        often = 2 * 4 ** max(0, step - STEPS + 1)

        def more(x, h, lacking=lacking, cost=cost, step=step, often=often):
            picked = []
            for i, s in enumerate(specs):
                if cost.get(s, 0) > 0:
                    u = _uniform(h, s[1], step + 1)
                    r = np.flatnonzero(u * cost[s] < often * s[0] * _nearest(x, lacking[s])[1])
                    picked.append((i, r, u[r]))
            return picked

        # about 2k points a chain, whatever the data's size
        rows = _drawn(points, features, id_col, more).select("chain", "x").distinct().collect()
        for i, xs in _by_chain(rows).items():
            found[specs[i]] = np.unique(np.vstack([found[specs[i]], np.array(xs)]), axis=0)
    weights = _scan(points, features, found)
    return {s: _plus_plus(c, weights[s][0], *s) for s, c in found.items()}


def step(points: DataFrame, features: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One K-means step: (sizes, new centres, cost) of the clusters around the given centres."""
    n, sums, cost = _scan(points, features, {(len(centres), 0): centres})[(len(centres), 0)]
    return n, _moved(n, sums, centres), cost


def fit(points: DataFrame, specs: list[Spec], features: str = "x", id_col: str = "customer_id",
        max_iter: int = 300, tol: float = 1e-4) -> dict[Spec, tuple[float, np.ndarray, np.ndarray]]:
    """(cost, centres, sizes) of every chain; ``points`` should be a written frame.

    Clusters are numbered by size, largest first, ties by centre, so that
    numbers do not depend on the seed; empty ones are left out.
    """
    centres = starts(points, list(dict.fromkeys(specs)), features, id_col)
    going = set(centres)
    for _ in range(max_iter):
        if not going:
            break
        for s, (n, sums, _) in _scan(points, features, {s: centres[s] for s in centres if s in going}).items():
            new = _moved(n, sums, centres[s])
            if ((new - centres[s]) ** 2).sum(axis=1).max() <= tol * tol:
                going.discard(s)
            centres[s] = new
    out = {}
    for s, (n, _, cost) in (_scan(points, features, centres) if centres else {}).items():
        order = sorted(np.flatnonzero(n), key=lambda c: (-n[c], tuple(np.round(centres[s][c], 12))))
        out[s] = cost, centres[s][order], n[order]
    return out


def best(fits: dict[Spec, tuple[float, np.ndarray, np.ndarray]], k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The chain of least cost for k, ties by seed."""
    return fits[min((s for s in fits if s[0] == k), key=lambda s: (fits[s][0], s[1]))]


def nearest(features: str, *centres: np.ndarray) -> Column:
    """Array of the numbers of the nearest centre, one for each set of centres."""
    @F.pandas_udf("array<long>")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.stack(b.to_numpy()) if len(b) else np.empty((0, 1))
            near = np.column_stack([_nearest(x, c)[0] for c in centres]) if len(b) else []
            yield pd.Series(list(near), dtype=object)
    return labels(features)
