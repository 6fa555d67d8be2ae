"""numpy forms of the two log-likelihoods and their gradients, evaluated
inside Spark tasks by the batched fit (one array op covers every row of a
partition against every candidate of its replicate). Log-gamma and digamma
depend on the purchase count alone, so they are evaluated once a distinct count."""
from __future__ import annotations

import numpy as np

from ...functions.special import np_digamma as psi
from ...functions.special import np_lgamma as lg


def _softplus(z):
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))


def _distinct(x):
    """Distinct values of x [1, R] as [1, U], and a function that lays values [K, U] out for the rows."""
    values, at = np.unique(x[0], return_inverse=True)
    return values[None, :], lambda v: v[:, at]


def bgnbd(cols, theta):
    """cols: (x, t_x, T) arrays [1, R]; theta: [K, 4] -> ll [K, R], grads 4 x [K, R]."""
    x, tx, T = cols
    r, alpha, a, b = (theta[:, i:i + 1] for i in range(4))
    xu, rows = _distinct(x)
    rx = r + x
    l_aT = np.log(alpha + T)
    l_atx = np.log(alpha + tx)
    pos = x > 0
    bx1 = np.where(pos, b + x - 1.0, 1.0)
    with np.errstate(over="ignore", invalid="ignore"):
        a3 = np.log(a) - np.log(bx1) + rx * (l_aT - l_atx)
        ll = (rows(lg(r + xu)) - lg(r) + r * np.log(alpha) - rx * l_aT
              + lg(a + b) + rows(lg(b + xu)) - lg(b) - rows(lg(a + b + xu))
              + np.where(pos, _softplus(a3), 0.0))
        s = np.where(pos, 1.0 / (1.0 + np.exp(-a3)), 0.0)
    psi_ab, psi_abx = psi(a + b), rows(psi(a + b + xu))
    g_r = rows(psi(r + xu)) - psi(r) + np.log(alpha) - l_aT + s * (l_aT - l_atx)
    g_alpha = r / alpha - rx / (alpha + T) + s * rx * (1.0 / (alpha + T) - 1.0 / (alpha + tx))
    g_a = psi_ab - psi_abx + s / a
    g_b = psi_ab + rows(psi(b + xu)) - psi(b) - psi_abx - s / bx1
    return ll, [g_r, g_alpha, g_a, g_b]


def gamma_gamma(cols, theta):
    """cols: (x, m) arrays [1, R]; theta: [K, 3] -> ll [K, R], grads 3 x [K, R]."""
    x, m = cols
    p, q, gamma = (theta[:, i:i + 1] for i in range(3))
    xu, rows = _distinct(x)
    px, pu = p * x, p * xu
    l_gxm = np.log(gamma + x * m)
    ll = (rows(lg(pu + q)) - rows(lg(pu)) - lg(q) + q * np.log(gamma)
          + (px - 1.0) * np.log(m) + px * np.log(x) - (px + q) * l_gxm)
    psi_pxq = rows(psi(pu + q))
    g_p = x * (psi_pxq - rows(psi(pu)) + np.log(m) + np.log(x) - l_gxm)
    g_q = psi_pxq - psi(q) + np.log(gamma) - l_gxm
    g_gamma = q / gamma - (px + q) / (gamma + x * m)
    return ll, [g_p, g_q, g_gamma]
