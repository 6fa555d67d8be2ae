"""CLV uncertainty (V10-V12): customer bootstrap and parameter perturbation.

Bootstrap: instead of materialising B resampled copies, every cell of customers
with equal observations gets one Poisson(count) weight a replicate (``cells``),
the standard distributed bootstrap, stable under re-execution and
repartitioning. A cell stays one row, with its B weights as an array, and all B
fits advance together, one Spark job per pass.
Scoring evaluates all B parameter rows for a slice of customers as one numpy
array inside a task; mean, percentiles and deviation of a customer are made
there, so nothing is shuffled, and totals leave as one row a partition and
replicate.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ...functions.scaling import attach_row
from ...functions.special import hyp2f1_series
from ...functions.validation import require_columns
from ...storage import kept
from ..order_stats import quantiles
from . import estimate as E
from . import kernels as K
from . import models as M
from .cells import cell_weights, summed
from .fit import maximize

SLICE = 1024  # customers evaluated together


def _draws(x, tx, T, m, mbar, theta, horizon: float, discount_rate: float, formula: str) -> np.ndarray:
    """CLV of R customers (arrays [R]) under B parameter rows (theta [B, 7]) as [R, B]:
    the numpy form of ``models.clv_column``."""
    x, tx, T, m, mbar = (np.asarray(v, float)[:, None] for v in (x, tx, T, m, mbar))
    r, alpha, a, b, p, q, gamma = theta.T[:, None, :]
    with np.errstate(all="ignore"):
        z = horizon / (alpha + T + horizon)
        c = a + b + x - 1.0
        lanes = np.broadcast_arrays(c - r - x, a - 1.0, c, z)
        tail = np.power(1.0 - z, a - 1.0) * hyp2f1_series(*[v.ravel() for v in lanes]).reshape(lanes[0].shape)
        ratio = np.exp((r + x) * (np.log(alpha + T) - np.log(alpha + tx)))
        denom = 1.0 + np.where(x > 0, a / np.maximum(b + x - 1.0, 1e-9) * ratio, 0.0)
        model = (a + b + x - 1.0) / (a - 1.0) * (1.0 - tail) / denom
        bought = np.maximum(np.where(a <= 1.0, x * (horizon / np.maximum(T, 1e-9)), model), 0.0)
        den = p * x + q - 1.0
        if formula == "published":
            spend = np.where(den > 1e-9, p * (gamma + x * m) / den, mbar)
        elif formula == "reference":
            mean = np.where(q > 1.0, gamma * p / (q - 1.0), mbar)
            spend = (p * x * m + gamma * (q - 1.0) * mean) / np.maximum(den, 1e-9)
        else:
            raise ValueError("formula must be 'published' or 'reference'")
    v = bought * spend
    return v / (1.0 + discount_rate) ** (horizon / 365.0) if discount_rate > 0 else v


def _scored(summary: DataFrame, rows: dict, horizon, discount_rate, formula, id_col):
    """The frame to score and a function from its Arrow batches to (ids, [rows, replicates]) slices.

    All values of a customer are made in one place, so no row leaves its
    task more than once; the parameter rows travel in the closure.
    """
    base = E.with_spend_fallback(summary.select(id_col, "frequency", "recency", "T", "monetary_value"), formula)
    theta = np.array([rows[k] for k in sorted(rows)], float)

    def values(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), SLICE):
                part = pdf.iloc[lo:lo + SLICE]
                yield part[id_col], _draws(*(part[c].to_numpy(float) for c in (
                    "frequency", "recency", "T", "monetary_value", "__mbar")), theta, horizon, discount_rate, formula)

    return base.select(id_col, "frequency", "recency", "T", "monetary_value", "__mbar"), values


def _per_customer(base: DataFrame, values, id_col: str, p_low: float, p_high: float, low_name: str, high_name: str):
    def run(batches):
        for ids, v in values(batches):
            low, mid, high = np.percentile(v, [p_low, 50.0, p_high], axis=1)
            yield pd.DataFrame({id_col: ids.to_numpy(), "clv_mean": v.mean(axis=1), low_name: low, "clv_p50": mid,
                                high_name: high, "clv_std": v.std(axis=1, ddof=1) if v.shape[1] > 1 else np.nan})

    schema = StructType([base.schema[id_col]] + [StructField(c, DoubleType())
                                                 for c in ("clv_mean", low_name, "clv_p50", high_name, "clv_std")])
    return base.mapInPandas(run, schema)


def _totals(base: DataFrame, values, n: int) -> DataFrame:
    """(replicate, total): one partial row a partition and replicate, added by Spark."""
    def run(batches):
        total = np.zeros(n)
        for _, v in values(batches):
            total += np.nansum(v, axis=0)
        yield pd.DataFrame({"replicate": np.arange(n), "total": total})

    return base.mapInPandas(run, "replicate long, total double").groupBy("replicate").agg(F.sum("total").alias("total"))


def bootstrap_clv(summary: DataFrame, horizon: float = 365.0, discount_rate: float = 0.0,
                  n_bootstrap: int = 100, alpha: float = 0.05, seed: int = 42,
                  id_col: str = "customer_id", formula: str = "published", penalty: float = 1e-3,
                  with_samples: bool = False):
    """Per-customer CLV distribution over ``n_bootstrap`` refits.

    Returns (customer_clv, totals): customer_clv has clv_mean,
    clv_p{low:02d}, clv_p50, clv_p{high:02d}, clv_std per customer; totals is
    one row with horizon_days, n_bootstrap (successful), n_customers,
    n_failed and the mean and interval of the total CLV across replicates.
    ``with_samples`` adds the total of every replicate as a third frame.
    """
    require_columns(summary, ["frequency", "recency", "T", "monetary_value"], "bootstrap_clv")
    if n_bootstrap < 10:
        raise ValueError("n_bootstrap < 10 is too few to estimate percentiles")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    spark = summary.sparkSession
    bg0, gg0 = E.fit_both(summary, penalty)

    cell = ["frequency", "recency", "T", "monetary_value"]
    weighted = kept(cell_weights(summary.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), cell, n_bootstrap, seed))
    bg_data = summed(weighted, ["frequency", "recency", "T"], n_bootstrap).persist()
    gg_data = summed(weighted.where(F.col("frequency") >= 1), ["frequency", "monetary_value"], n_bootstrap).persist()
    try:
        drawn = gg_data.agg(*[F.sum(F.col("weights")[b]).alias(f"n{b}") for b in range(n_bootstrap)]).first()
        repeat = {b: drawn[b] or 0 for b in range(n_bootstrap)}
        start_bg = np.array([bg0.r, bg0.alpha, bg0.a, bg0.b])
        start_gg = np.array([gg0.p, gg0.q, gg0.gamma])
        ok_gg = [b for b in range(n_bootstrap) if repeat.get(b, 0) >= 2]
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=2) as pool:
            f_bg = pool.submit(maximize, bg_data, K.bgnbd, ["frequency", "recency", "T"], M.BGNBD_NAMES,
                               {b: [start_bg] for b in range(n_bootstrap)}, M.BGNBD_LOWER, M.BGNBD_UPPER, penalty)
            f_gg = pool.submit(maximize, gg_data, K.gamma_gamma, ["frequency", "monetary_value"], M.GG_NAMES,
                               {b: [start_gg] for b in ok_gg}, M.GG_LOWER, M.GG_UPPER, penalty)
            bg_fits, gg_fits = f_bg.result(), f_gg.result()
    finally:
        bg_data.unpersist()
        gg_data.unpersist()
    good = sorted(b for b in bg_fits if b in gg_fits)
    n_failed = n_bootstrap - len(good)
    if len(good) < 10:
        raise RuntimeError(f"only {len(good)} bootstrap fits succeeded (< 10)")
    rows = {i: (*bg_fits[b].theta, *gg_fits[b].theta) for i, b in enumerate(good)}
    base, values = _scored(summary, rows, horizon, discount_rate, formula, id_col)
    p_low, p_high = alpha / 2 * 100, (1 - alpha / 2) * 100
    low_name, high_name = f"clv_p{int(p_low):02d}", f"clv_p{int(p_high):02d}"
    customer_clv = _per_customer(base, values, id_col, p_low, p_high, low_name, high_name)
    samples = _totals(base, values, len(rows))
    totals = (samples.agg(F.avg("total").alias("total_clv_mean"),
                          F.percentile("total", [p_low / 100.0, p_high / 100.0]).alias("__ci"))  # one row a replicate
              .select(F.lit(float(horizon)).alias("horizon_days"),
                      F.lit(len(good)).alias("n_bootstrap"),
                      F.lit(n_failed).alias("n_failed"),
                      "total_clv_mean",
                      F.col("__ci")[0].alias("total_clv_ci_low"),
                      F.col("__ci")[1].alias("total_clv_ci_high")))
    totals = attach_row(totals, summary.agg(F.count(F.lit(1)).alias("n_customers")))
    return (customer_clv, totals, samples) if with_samples else (customer_clv, totals)


def perturbation_draws(bg: M.BGNBDParams, gg: M.GammaGammaParams, n_perturbations: int = 200,
                       relative_noise: float = 0.05, seed: int = 42) -> dict:
    """Driver-side draws: each of the 7 parameters times (1 + N(0, noise)),
    floored at 1e-6, in the reference's draw order. The fitted parameters
    are not touched."""
    if relative_noise <= 0:
        raise ValueError("relative_noise must be > 0")
    rng = np.random.default_rng(seed)
    base = [bg.r, bg.alpha, bg.a, bg.b, gg.p, gg.q, gg.gamma]
    out = {}
    for k in range(n_perturbations):
        out[k] = tuple(max(v * (1 + rng.normal(0, relative_noise)), 1e-6) for v in base)
    return out


def parameter_perturbation_clv(bg: M.BGNBDParams, gg: M.GammaGammaParams, summary: DataFrame,
                               horizon: float = 365.0, discount_rate: float = 0.0,
                               n_perturbations: int = 200, relative_noise: float = 0.05,
                               seed: int = 42, id_col: str = "customer_id",
                               formula: str = "published") -> DataFrame:
    """clv_mean, clv_p05, clv_p95, clv_std per customer over perturbed
    parameter draws (V12), all draws of a customer in one place."""
    if bg is None or gg is None:
        raise ValueError("both models must be fitted first")
    draws = perturbation_draws(bg, gg, n_perturbations, relative_noise, seed)
    base, values = _scored(summary, draws, horizon, discount_rate, formula, id_col)
    return _per_customer(base, values, id_col, 5.0, 95.0, "clv_p05", "clv_p95").select(
        id_col, "clv_mean", "clv_p05", "clv_p95", "clv_std")


def describe(customer_clv: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of every per-customer column, a row a statistic.
    Quartiles are exact, by linear interpolation; a column without values counts 0 and has nulls."""
    cols = [c for c in customer_clv.columns if c.startswith("clv_")]
    values = kept(customer_clv.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    plain = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = values.agg(*[f(c).cast("double").alias(f"{c}_{name}") for c in cols for name, f in plain.items()]).first()
    quartile = {"25%": 0, "50%": 1, "75%": 2}
    found = quantiles(values, cols, [0.25, 0.5, 0.75])
    rows = [(name, *[(found[c] or [None] * 3)[quartile[name]] if name in quartile else row[f"{c}_{name}"] for c in cols])
            for name in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")]
    return values.sparkSession.createDataFrame(rows, "statistic string, " + ", ".join(f"{c} double" for c in cols))
