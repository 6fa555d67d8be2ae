"""Special functions as Spark Column expressions (F7) plus Gauss 2F1 (F8).

Spark SQL has no log-gamma. ``lgamma`` shifts the argument up by seven with
the recurrence lgamma(z) = lgamma(z + 7) - sum(log(z + i)) and evaluates the
Stirling series there; for z > 0 the error is below 1e-11. ``digamma`` uses
the same shift. Both stay inside whole-stage codegen.

``hyp2f1_transformed`` is the one vectorised Python function of the
library: an Arrow ``pandas_udf`` summing the power series of 2F1 with a
term-size stop, used only by the BG/NBD purchase forecast.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

SHIFT = 7
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def lgamma(z) -> Column:
    """log Gamma(z) for z > 0 as a Column expression."""
    z = _c(z)
    w = z + SHIFT
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * (1.0 / 12 + inv2 * (-1.0 / 360 + inv2 * (1.0 / 1260 + inv2 * (-1.0 / 1680))))
    stirling = (w - 0.5) * F.log(w) - w + HALF_LOG_2PI + series
    shift = F.log(z)
    for i in range(1, SHIFT):
        shift = shift + F.log(z + i)
    return stirling - shift


def digamma(z) -> Column:
    """psi(z) for z > 0 as a Column expression."""
    z = _c(z)
    w = z + SHIFT
    inv = 1.0 / w
    inv2 = inv * inv
    series = F.log(w) - 0.5 * inv - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240))))
    shift = 1.0 / z
    for i in range(1, SHIFT):
        shift = shift + 1.0 / (z + i)
    return series - shift


def np_lgamma(z: np.ndarray) -> np.ndarray:
    """Same series in numpy (for tests and driver-side checks)."""
    z = np.asarray(z, dtype=float)
    w = z + SHIFT
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * (1.0 / 12 + inv2 * (-1.0 / 360 + inv2 * (1.0 / 1260 + inv2 * (-1.0 / 1680))))
    out = (w - 0.5) * np.log(w) - w + HALF_LOG_2PI + series
    for i in range(SHIFT):
        out = out - np.log(z + i)
    return out


def hyp2f1_series(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray,
                  tol: float = 1e-15, max_terms: int = 20_000_000) -> np.ndarray:
    """Vectorised power series of 2F1(a, b; c; z) for 0 <= z < 1.

    Each lane stops once its term is below ``tol`` relative to its sum.
    """
    a, b, c, z = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (a, b, c, z))
    a, b, c, z = (np.array(v) for v in np.broadcast_arrays(a, b, c, z))
    total = np.ones_like(z)
    term = np.ones_like(z)
    active = np.ones(z.shape, dtype=bool)
    n = 0
    while active.any() and n < max_terms:
        idx = np.nonzero(active)[0]
        term[idx] = term[idx] * (a[idx] + n) * (b[idx] + n) / ((c[idx] + n) * (n + 1.0)) * z[idx]
        total[idx] += term[idx]
        done = np.abs(term[idx]) <= tol * np.abs(total[idx])
        active[idx[done]] = False
        n += 1
    if active.any():
        raise ArithmeticError("2F1 series did not converge; its last argument is too close to 1")
    return total


@pandas_udf(DoubleType())
def bgnbd_tail_udf(r: pd.Series, alpha: pd.Series, a: pd.Series, b: pd.Series,
                   x: pd.Series, T: pd.Series, t: pd.Series) -> pd.Series:
    """((alpha+T)/(alpha+T+t))^(r+x) * 2F1(r+x, b+x; a+b+x-1; t/(alpha+T+t)).

    Evaluated through the Euler transformation
    (1-z)^(r+x) 2F1(r+x, b+x; c; z) = (1-z)^(a-1) 2F1(a+b-1-r, a-1; c; z)
    with c = a+b+x-1 and 1-z = (alpha+T)/(alpha+T+t); the transformed series
    needs few terms even for heavy buyers.
    """
    r, alpha, a, b, x, T, t = (s.to_numpy(dtype=float) for s in (r, alpha, a, b, x, T, t))
    z = t / (alpha + T + t)
    c = a + b + x - 1.0
    hyp = hyp2f1_series(c - r - x, a - 1.0, c, z)
    return pd.Series(np.power(1.0 - z, a - 1.0) * hyp)


def np_digamma(z: np.ndarray) -> np.ndarray:
    """psi(z) for z > 0 in numpy, same shift and series as ``digamma``."""
    z = np.asarray(z, dtype=float)
    w = z + SHIFT
    inv = 1.0 / w
    inv2 = inv * inv
    out = np.log(w) - 0.5 * inv - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240))))
    for i in range(SHIFT):
        out = out - 1.0 / (z + i)
    return out
