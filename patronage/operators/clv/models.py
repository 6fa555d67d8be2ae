"""BG/NBD (Fader, Hardie, Lee 2005) and Gamma-Gamma (Fader, Hardie 2013)
as Spark Column expressions: per-customer log-likelihood with its gradient
(for the batched fit), and the scoring formulas.

Parameters are ordinary columns (attached from a small broadcast parameter
frame), never literals, so one compiled plan serves every parameter set.
"""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.special import bgnbd_tail_udf, digamma, lgamma

BGNBD_NAMES = ("r", "alpha", "a", "b")
GG_NAMES = ("p", "q", "gamma")

# Optimisation bounds and starting points of both fits.
BGNBD_LOWER = (1e-4, 1e-4, 1.001, 1e-4)
BGNBD_UPPER = (1e4, 1e4, 1e4, 1e4)
BGNBD_STARTS = ((1.0, 1.0, 1.5, 1.0), (0.5, 10.0, 1.2, 2.0), (2.0, 5.0, 2.0, 3.0))
GG_LOWER = (1e-4, 1e-4, 1e-4)
GG_UPPER = (1e4, 1e4, 1e4)
GG_STARTS = ((1.0, 1.0, 1.0), (3.0, 4.0, 5.0), (5.0, 10.0, 30.0))


@dataclass
class BGNBDParams:
    r: float
    alpha: float
    a: float
    b: float

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


@dataclass
class GammaGammaParams:
    p: float
    q: float
    gamma: float

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bgnbd_terms(x: Column, tx: Column, T: Column, r: Column, alpha: Column, a: Column, b: Column):
    """(log-likelihood, [d/dr, d/dalpha, d/da, d/db]) of one customer.

    For x = 0 the second path is absent; it is switched off with ``when``
    rather than multiplied by zero, so b < 1 cannot turn the sum into NaN.
    """
    x = x.cast("double")
    tx = tx.cast("double")
    T = T.cast("double")
    rx = r + x
    l_aT = F.log(alpha + T)
    l_atx = F.log(alpha + tx)
    pos = x > 0
    bx1 = F.when(pos, b + x - 1.0).otherwise(F.lit(1.0))
    a3 = F.log(a) - F.log(bx1) + rx * (l_aT - l_atx)
    ll = (lgamma(rx) - lgamma(r) + r * F.log(alpha) - rx * l_aT
          + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
          + F.when(pos, _softplus(a3)).otherwise(F.lit(0.0)))
    s = F.when(pos, 1.0 / (1.0 + F.exp(-a3))).otherwise(F.lit(0.0))
    psi_ab, psi_abx = digamma(a + b), digamma(a + b + x)
    g_r = digamma(rx) - digamma(r) + F.log(alpha) - l_aT + s * (l_aT - l_atx)
    g_alpha = r / alpha - rx / (alpha + T) + s * rx * (1.0 / (alpha + T) - 1.0 / (alpha + tx))
    g_a = psi_ab - psi_abx + s / a
    g_b = psi_ab + digamma(b + x) - digamma(b) - psi_abx - s / bx1
    return ll, [g_r, g_alpha, g_a, g_b]


def gg_terms(x: Column, m: Column, p: Column, q: Column, gamma: Column):
    """(log-likelihood, [d/dp, d/dq, d/dgamma]) of one repeat customer."""
    x = x.cast("double")
    m = m.cast("double")
    px = p * x
    l_gxm = F.log(gamma + x * m)
    ll = (lgamma(px + q) - lgamma(px) - lgamma(q) + q * F.log(gamma)
          + (px - 1.0) * F.log(m) + px * F.log(x) - (px + q) * l_gxm)
    psi_pxq = digamma(px + q)
    g_p = x * (psi_pxq - digamma(px) + F.log(m) + F.log(x) - l_gxm)
    g_q = psi_pxq - digamma(q) + F.log(gamma) - l_gxm
    g_gamma = q / gamma - (px + q) / (gamma + x * m)
    return ll, [g_p, g_q, g_gamma]


# ---------------------------------------------------------------- scoring --

def expected_purchases(t, x="frequency", tx="recency", T="T",
                       r="r", alpha="alpha", a="a", b="b") -> Column:
    """E[purchases in the next t days | x, t_x, T] (FHL 2005 eq. 10).

    For a <= 1 the reference falls back to x t / T; the result is clamped at 0.
    """
    x, tx, T, r, alpha, a, b = (F.col(c).cast("double") if isinstance(c, str) else c
                                for c in (x, tx, T, r, alpha, a, b))
    t = t if isinstance(t, Column) else F.lit(float(t))
    tail = bgnbd_tail_udf(r, alpha, a, b, x, T, t)
    coef = (a + b + x - 1.0) / (a - 1.0)
    denom = 1.0 + F.when(x > 0, a / F.greatest(b + x - 1.0, F.lit(1e-9))
                         * F.exp((r + x) * (F.log(alpha + T) - F.log(alpha + tx)))).otherwise(F.lit(0.0))
    model = coef * (1.0 - tail) / denom
    fallback = x * (t / F.greatest(T, F.lit(1e-9)))
    return F.greatest(F.when(a <= 1.0, fallback).otherwise(model), F.lit(0.0))


def p_alive(x="frequency", tx="recency", T="T", r="r", alpha="alpha", a="a", b="b") -> Column:
    """P(still active | x, t_x, T); 1 when x = 0."""
    x, tx, T, r, alpha, a, b = (F.col(c).cast("double") if isinstance(c, str) else c
                                for c in (x, tx, T, r, alpha, a, b))
    ratio = F.exp((r + x) * (F.log(alpha + T) - F.log(alpha + tx)))
    return 1.0 / (1.0 + F.when(x > 0, a / F.greatest(b + x - 1.0, F.lit(1e-9)) * ratio).otherwise(F.lit(0.0)))


def conditional_mean_spend(x="frequency", m="monetary_value", p="p", q="q", gamma="gamma",
                           formula: str = "published", fallback_mean: Column | None = None) -> Column:
    """E[mean spend | x, m].

    ``published``: p (gamma + x m) / (p x + q - 1) (Fader and Hardie 2013).
    ``reference``: (p x m + gamma (q - 1) m_bar) / max(p x + q - 1, 1e-9) with
    m_bar = gamma p / (q - 1), which the reference library computes (it
    equals the published form only at gamma = 1); for q <= 1 m_bar is the
    mean of ``m``. ``fallback_mean`` (a column holding that mean) covers
    both q <= 1 cases.
    """
    x, m, p, q, gamma = (F.col(c).cast("double") if isinstance(c, str) else c for c in (x, m, p, q, gamma))
    fb = fallback_mean if fallback_mean is not None else F.lit(0.0)
    den = p * x + q - 1.0
    if formula == "published":
        return F.when(den > 1e-9, p * (gamma + x * m) / den).otherwise(fb)
    if formula == "reference":
        m_bar = F.when(q > 1.0, gamma * p / (q - 1.0)).otherwise(fb)
        return (p * x * m + gamma * (q - 1.0) * m_bar) / F.greatest(den, F.lit(1e-9))
    raise ValueError("formula must be 'published' or 'reference'")


def clv_column(horizon: float = 365.0, discount_rate: float = 0.0, formula: str = "published",
               fallback_mean: Column | None = None) -> Column:
    """Expected purchases in ``horizon`` days times the expected spend,
    discounted once by (1 + d)^(horizon / 365) when d > 0."""
    v = expected_purchases(horizon) * conditional_mean_spend(formula=formula, fallback_mean=fallback_mean)
    if discount_rate > 0:
        v = v / (1.0 + discount_rate) ** (horizon / 365.0)
    return v


def clv_name(horizon: float) -> str:
    return f"clv_{int(horizon)}d"


def with_params(df: DataFrame, params) -> DataFrame:
    """Attach one parameter set (dataclasses or a dict) as columns."""
    vals = {}
    for p in params if isinstance(params, (list, tuple)) else [params]:
        vals.update(p.to_dict() if hasattr(p, "to_dict") else dict(p))
    return df.select("*", *[F.lit(float(v)).alias(k) for k, v in vals.items()])
