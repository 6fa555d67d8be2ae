"""Batched maximum likelihood for BG/NBD and Gamma-Gamma without scipy.

The data side is a compressed frame (one row per distinct observation with a
weight column ``w`` and a ``replicate`` key, or an array ``weights`` of one
weight a replicate). One optimisation pass is one
Spark job: every candidate parameter set of every chain is attached to the
rows of its replicate by a broadcast equi-join on ``replicate`` (the
candidate table is bounded by chains x step lengths, checked below), and a
grouped aggregate returns, per candidate, the weighted log-likelihood, its
gradient and the BHHH outer-product sums. Only those few numbers per
candidate reach the driver.

The driver runs a projected quasi-Newton method in u = log(theta) within the
box bounds: the first curvature matrix is BHHH (the information matrix),
later ones are BFGS updates; each pass tries several step lengths at once.
Objective, as in the reference: -sum(LL) + penalty * sum(theta^2).
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

STEPS = (2.0, 1.0, 0.5, 0.25, 0.1, 0.02)  # one pass tries all; 2.0 helps along flat ridges
MAX_CANDIDATES = 200_000  # of one job, whose closure carries them; more take several jobs


@dataclass
class Chain:
    key: int
    replicate: int
    u: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    f: float = math.inf
    g: np.ndarray | None = None
    H: np.ndarray | None = None
    B: np.ndarray | None = None
    lam: float = 0.0
    iters: int = 0
    converged: bool = False
    failed: bool = False
    done: bool = False
    pending: list = field(default_factory=list)


@dataclass
class FitResult:
    theta: np.ndarray
    objective: float
    converged: bool
    iterations: int


def _objective(stats, theta, penalty):
    """f, gradient and curvature in u space from one candidate's sums."""
    ll, grad, outer = stats
    f = -ll + penalty * float(np.sum(theta ** 2))
    g_theta = -grad + 2.0 * penalty * theta
    g_u = theta * g_theta
    B = outer + 2.0 * penalty * np.eye(len(theta))
    H_u = (theta[:, None] * B) * theta[None, :]
    return f, g_u, H_u


def _evaluate(data: DataFrame, kernel, data_cols, names, cands):
    """One Spark job: weighted sums per candidate.

    ``cands`` = [(cid, replicate, theta)], at most MAX_CANDIDATES rows; it
    travels to the tasks inside the function closure (a broadcast of a
    checked size). Each task evaluates its rows of a replicate against all
    candidates of that replicate in one array operation and emits one row
    of partial sums per candidate; Spark adds the partials up by candidate.
    """
    if len(cands) > MAX_CANDIDATES:
        out: dict = {}
        for i in range(0, len(cands), MAX_CANDIDATES):
            out |= _evaluate(data, kernel, data_cols, names, cands[i:i + MAX_CANDIDATES])
        return out
    d = len(names)
    by_rep: dict = {}
    for cid, rep, th in cands:
        by_rep.setdefault(int(rep), []).append((int(cid), np.asarray(th, float)))
    by_rep = {r: (np.array([c for c, _ in v], dtype=np.int64), np.vstack([t for _, t in v]))
              for r, v in by_rep.items()}
    pairs = [(i, k) for i in range(d) for k in range(i, d)]
    out_cols = ["ll"] + [f"g{i}" for i in range(d)] + [f"o{i}_{k}" for i, k in pairs]
    schema = StructType([StructField("__cid", LongType())] + [StructField(c, DoubleType()) for c in out_cols])

    arrays = "weights" in data.columns

    def parts(pdf):
        """(replicate, columns of its rows, their weights)."""
        if not arrays:
            for rep, sub in pdf.groupby("replicate", sort=False):
                yield rep, [sub[c].to_numpy(dtype=float) for c in data_cols], sub["w"].to_numpy(dtype=float)
            return
        weights = np.vstack(pdf["weights"].to_list()) if len(pdf) else np.zeros((0, 0))
        cols = [pdf[c].to_numpy(dtype=float) for c in data_cols]
        for rep in by_rep if len(pdf) else ():
            drawn = weights[:, rep] > 0
            yield rep, [c[drawn] for c in cols], weights[drawn, rep].astype(float)

    def run(batches):
        import pandas as pd
        acc = {}
        for pdf in batches:
            for rep, cols, w in parts(pdf):
                got = by_rep.get(int(rep))
                if got is None or not len(w):
                    continue
                cids, theta = got
                cols, w = [c[None, :] for c in cols], w[None, :]
                with np.errstate(all="ignore"):
                    ll, grads = kernel(cols, theta)
                    vals = [(w * ll).sum(axis=1)] + [(w * g).sum(axis=1) for g in grads]
                    vals += [(w * grads[i] * grads[k]).sum(axis=1) for i, k in pairs]
                block = np.vstack(vals).T
                for j, cid in enumerate(cids):
                    acc[cid] = acc[cid] + block[j] if cid in acc else block[j].copy()
        if acc:
            keys = list(acc)
            frame = pd.DataFrame(np.vstack([acc[k] for k in keys]), columns=out_cols)
            frame.insert(0, "__cid", np.array(keys, dtype=np.int64))
            yield frame

    partial = data.select(*(["weights"] if arrays else ["replicate", "w"]), *data_cols).mapInPandas(run, schema)
    # one partial row for each partition and candidate, added in Spark: one row a candidate comes back
    rows = [r.asDict() for r in partial.groupBy("__cid").agg(*[F.sum(c).alias(c) for c in out_cols]).collect()]
    out = {}
    for row in rows:
        grad = np.array([row[f"g{i}"] for i in range(d)], dtype=float)
        outer = np.zeros((d, d))
        for i, k in pairs:
            outer[i, k] = outer[k, i] = row[f"o{i}_{k}"]
        out[int(row["__cid"])] = (float(row["ll"]) if row["ll"] is not None else math.nan, grad, outer)
    return out


def _free(ch: Chain, eps=1e-12):
    at_lo = (ch.u <= ch.lo + eps) & (ch.g > 0)
    at_hi = (ch.u >= ch.hi - eps) & (ch.g < 0)
    return ~(at_lo | at_hi)


def _direction(ch: Chain):
    free = _free(ch)
    d = np.zeros_like(ch.u)
    if not free.any():
        return d
    H = ch.H[np.ix_(free, free)]
    H = H + ch.lam * np.diag(np.maximum(np.diag(H), 1e-12))
    g = ch.g[free]
    try:
        step = -np.linalg.solve(H, g)
        if not np.all(np.isfinite(step)) or step @ g >= 0:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        step = -g / max(np.max(np.abs(np.diag(H))), 1e-12)
    d[free] = step
    m = np.max(np.abs(d))
    if m > 2.0:
        d *= 2.0 / m
    return d


def maximize(data: DataFrame, terms_fn, data_cols, names, starts_by_replicate: dict,
             lower, upper, penalty: float = 1e-3, max_iter: int = 500,
             ftol: float = 1e-12, gtol: float = 1e-9, curvature: str = "bfgs", steps=STEPS) -> dict:
    """Fit every replicate in ``starts_by_replicate`` ({replicate: [theta0, ...]}).

    Returns {replicate: FitResult of the best converged chain} (replicates
    with no converged chain are absent).
    """
    lo, hi = np.log(np.asarray(lower, float)), np.log(np.asarray(upper, float))
    chains = []
    for rep, starts in starts_by_replicate.items():
        for th in starts:
            u = np.clip(np.log(np.asarray(th, float)), lo, hi)
            chains.append(Chain(key=len(chains), replicate=int(rep), u=u, lo=lo, hi=hi))
    # initial pass at the starting points
    res = _evaluate(data, terms_fn, data_cols, names, [(c.key, c.replicate, np.exp(c.u)) for c in chains])
    for c in chains:
        st = res.get(c.key)
        if st is None or not math.isfinite(st[0]):
            c.failed = c.done = True
            continue
        c.f, c.g, c.B = _objective(st, np.exp(c.u), penalty)
        c.H = c.B.copy()
    while True:
        active = [c for c in chains if not c.done]
        if not active:
            break
        cands = []
        for c in active:
            free = _free(c)
            if not free.any() or np.max(np.abs(c.g[free])) <= gtol * max(1.0, abs(c.f)):
                c.converged = c.done = True
                continue
            d = _direction(c)
            c.pending = []
            for s in steps:
                u_new = np.clip(c.u + s * d, c.lo, c.hi)
                cid = len(cands)
                cands.append((cid, c.replicate, np.exp(u_new)))
                c.pending.append((cid, s, u_new))
        if not cands:
            break
        res = _evaluate(data, terms_fn, data_cols, names, cands)
        for c in active:
            if c.done:
                continue
            c.iters += 1
            best = None
            for cid, s, u_new in c.pending:
                st = res.get(cid)
                if st is None or not math.isfinite(st[0]):
                    continue
                f_new, g_new, B_new = _objective(st, np.exp(u_new), penalty)
                if math.isfinite(f_new) and (best is None or f_new < best[0]):
                    best = (f_new, g_new, B_new, u_new, s)
            if best is not None and best[0] < c.f:
                f_new, g_new, B_new, u_new, s = best
                du, dg = u_new - c.u, g_new - c.g
                rel = (c.f - f_new) / max(abs(c.f), abs(f_new), 1.0)
                sy = float(du @ dg)
                if curvature == "bhhh":
                    c.H = B_new.copy()
                elif sy > 1e-16 * max(1.0, float(du @ du)):
                    Hs = c.H @ du
                    c.H = c.H - np.outer(Hs, Hs) / float(du @ Hs) + np.outer(dg, dg) / sy
                else:
                    c.H = B_new.copy()
                c.u, c.f, c.g, c.B = u_new, f_new, g_new, B_new
                c.lam = c.lam / 4.0 if c.lam > 1e-8 else 0.0
                if rel <= ftol and s >= 0.5:
                    c.converged = c.done = True
            else:
                # no decrease: restart the curvature from BHHH and damp
                c.H = c.B.copy()
                c.lam = 1e-3 if c.lam == 0.0 else c.lam * 10.0
                if c.lam > 1e8:
                    c.converged = c.done = True  # stationary to working precision
            if c.iters >= max_iter and not c.done:
                c.done = True
    best_by_rep: dict = {}
    for c in chains:
        if not c.converged or c.failed:
            continue
        cur = best_by_rep.get(c.replicate)
        if cur is None or c.f < cur.objective:
            best_by_rep[c.replicate] = FitResult(np.exp(c.u), c.f, True, c.iters)
    return best_by_rep
