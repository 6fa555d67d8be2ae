"""Fit and score BG/NBD + Gamma-Gamma on a CLV summary frame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.scaling import attach_row
from ...functions.validation import count_violations, require_columns
from ...storage import kept
from . import kernels as K
from . import models as M
from .fit import maximize


def bgnbd_data(summary: DataFrame, replicate: int = 0) -> DataFrame:
    """Compressed BG/NBD input: one row per distinct (x, t_x, T) with its count."""
    return (summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("w"))
            .withColumn("replicate", F.lit(replicate).cast("long")))


def gg_data(summary: DataFrame, replicate: int = 0) -> DataFrame:
    """Compressed Gamma-Gamma input over repeat buyers (frequency >= 1)."""
    return (summary.where(F.col("frequency") >= 1)
            .groupBy("frequency", "monetary_value").agg(F.count(F.lit(1)).alias("w"))
            .withColumn("replicate", F.lit(replicate).cast("long")))


def check_bgnbd_input(summary: DataFrame) -> None:
    require_columns(summary, ["frequency", "recency", "T"], "BG/NBD fit")
    bad = count_violations(summary, recency_gt_T=F.col("recency") > F.col("T") + 1e-9)
    if bad["recency_gt_T"]:
        raise ValueError("rows with recency > T exist; check the input")


def check_gg_input(summary: DataFrame) -> None:
    require_columns(summary, ["frequency", "monetary_value"], "Gamma-Gamma fit")
    bad = count_violations(summary, nonpositive=(F.col("frequency") >= 1) & (F.col("monetary_value") <= 0),
                           repeat=F.col("frequency") >= 1)
    if bad["nonpositive"]:
        raise ValueError("monetary_value must be > 0 for customers with frequency >= 1")
    if bad["repeat"] == 0:
        raise RuntimeError("Gamma-Gamma fit needs repeat customers")


def bgnbd_loglik(data: DataFrame, params: M.BGNBDParams) -> DataFrame:
    """Summed BG/NBD log-likelihood at fixed parameters (V2), one row."""
    ll, _ = M.bgnbd_terms(F.col("frequency"), F.col("recency"), F.col("T"),
                          *[F.lit(float(v)) for v in (params.r, params.alpha, params.a, params.b)])
    w = F.col("w") if "w" in data.columns else F.lit(1)
    return data.agg(F.sum(w * ll).alias("loglik"))


def gg_loglik(data: DataFrame, params: M.GammaGammaParams) -> DataFrame:
    """Summed Gamma-Gamma log-likelihood over repeat buyers (V6), one row."""
    ll, _ = M.gg_terms(F.col("frequency"), F.col("monetary_value"),
                       *[F.lit(float(v)) for v in (params.p, params.q, params.gamma)])
    w = F.col("w") if "w" in data.columns else F.lit(1)
    return data.where(F.col("frequency") >= 1).agg(F.sum(w * ll).alias("loglik"))


def fit_bgnbd(summary: DataFrame, penalty: float = 1e-3, max_iter: int = 500) -> M.BGNBDParams:
    """Maximum penalised likelihood from the reference's three starts; the
    best converged start wins (V3)."""
    check_bgnbd_input(summary)
    data = kept(bgnbd_data(summary))  # small files: a pass is a few short tasks
    res = maximize(data, K.bgnbd, ["frequency", "recency", "T"], M.BGNBD_NAMES,
                   {0: list(M.BGNBD_STARTS)}, M.BGNBD_LOWER, M.BGNBD_UPPER, penalty, max_iter)
    if 0 not in res:
        raise RuntimeError("BG/NBD fit failed from every start")
    return M.BGNBDParams(*map(float, res[0].theta))


def fit_gamma_gamma(summary: DataFrame, penalty: float = 1e-3, max_iter: int = 500) -> M.GammaGammaParams:
    """Gamma-Gamma fit over repeat buyers (V7)."""
    check_gg_input(summary)
    data = kept(gg_data(summary))  # small files: a pass is a few short tasks
    res = maximize(data, K.gamma_gamma, ["frequency", "monetary_value"], M.GG_NAMES,
                   {0: list(M.GG_STARTS)}, M.GG_LOWER, M.GG_UPPER, penalty, max_iter)
    if 0 not in res:
        raise RuntimeError("Gamma-Gamma fit failed")
    return M.GammaGammaParams(*map(float, res[0].theta))


def fit_both(summary: DataFrame, penalty: float = 1e-3, max_iter: int = 500):
    """Both fits as concurrent driver loops (independent Spark jobs)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=2) as pool:
        bg = pool.submit(fit_bgnbd, summary, penalty, max_iter)
        gg = pool.submit(fit_gamma_gamma, summary, penalty, max_iter)
        return bg.result(), gg.result()


def params_frame(spark: SparkSession, bg: M.BGNBDParams, gg: M.GammaGammaParams | None = None) -> DataFrame:
    """One-row parameter frame."""
    vals = bg.to_dict()
    if gg is not None:
        vals.update(gg.to_dict())
    return spark.createDataFrame([tuple(float(v) for v in vals.values())], list(vals.keys()))


def with_spend_fallback(summary: DataFrame, formula: str) -> DataFrame:
    """Attach the observed mean spend used when q <= 1 (scalar aggregate)."""
    if formula == "reference":
        agg = summary.agg(F.avg("monetary_value").alias("__mbar"))
    else:
        agg = summary.agg(F.avg(F.when(F.col("frequency") >= 1, F.col("monetary_value"))).alias("__mbar"))
    return attach_row(summary, agg.select(F.coalesce("__mbar", F.lit(0.0)).alias("__mbar")))


def score(summary: DataFrame, bg: M.BGNBDParams, gg: M.GammaGammaParams | None = None,
          horizon: float = 365.0, discount_rate: float = 0.0, purchases_t: float | None = None,
          formula: str = "published") -> DataFrame:
    """Add p_alive, expected purchases, expected spend and CLV (V4, V5, V8, V9)."""
    df = M.with_params(summary, [bg] + ([gg] if gg is not None else []))
    df = df.withColumn("p_alive", M.p_alive())
    if purchases_t is not None:
        df = df.withColumn(f"expected_purchases_{int(purchases_t)}d", M.expected_purchases(purchases_t))
    if gg is not None:
        df = with_spend_fallback(df, formula)
        df = df.withColumn("expected_spend", M.conditional_mean_spend(formula=formula, fallback_mean=F.col("__mbar")))
        df = df.withColumn(M.clv_name(horizon), M.clv_column(horizon, discount_rate, formula, F.col("__mbar")))
        df = df.drop("__mbar")
    return df.drop(*M.BGNBD_NAMES, *(M.GG_NAMES if gg is not None else ()))
