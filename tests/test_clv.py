import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.functions import special
from patronage.operators.clv import estimate as E
from patronage.operators.clv import models as M
from patronage.operators.clv.summary import clv_summary


def _txn(spark):
    rows = [("A", dt.datetime(2024, 1, 1), 10.0), ("A", dt.datetime(2024, 1, 15), 20.0),
            ("A", dt.datetime(2024, 2, 1), 15.0), ("B", dt.datetime(2024, 1, 10), 30.0),
            ("B", dt.datetime(2024, 3, 1), 25.0), ("C", dt.datetime(2024, 2, 20), 40.0)]
    return spark.createDataFrame(rows, "customer_id string, date timestamp, amount double")


def test_summary_hand_values(spark):
    s = {r.customer_id: r for r in clv_summary(_txn(spark), observation_end=dt.datetime(2024, 4, 1)).collect()}
    assert (s["A"].frequency, s["A"].recency, s["A"].T, s["A"].monetary_value) == (2, 31, 91, 15.0)
    assert (s["C"].frequency, s["C"].monetary_value) == (0, 0.0)


def test_lgamma_digamma_accuracy(spark):
    zs = [1e-4, 0.3, 1.0, 2.5, 7.0, 40.0, 1234.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = df.select("z", special.lgamma(F.col("z")).alias("lg"), special.digamma(F.col("z")).alias("dg")).collect()
    for r in got:
        assert abs(r.lg - math.lgamma(r.z)) < 1e-9 * max(1.0, abs(math.lgamma(r.z)))
        h = 1e-5 * r.z
        fd = (math.lgamma(r.z + h) - math.lgamma(r.z - h)) / (2 * h)
        assert abs(r.dg - fd) < 1e-5 * max(1.0, abs(fd))


def test_hyp2f1_transform_matches_direct_series():
    r, alpha, a, b, x, T, t = 0.8, 10.0, 1.5, 2.0, 5.0, 100.0, 30.0
    z = t / (alpha + T + t)
    direct = special.hyp2f1_series(r + x, b + x, a + b + x - 1, z) * (1 - z) ** (r + x)
    c = a + b + x - 1
    trans = special.hyp2f1_series(c - r - x, a - 1, c, z) * (1 - z) ** (a - 1)
    assert abs(direct - trans) < 1e-12


def _population(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        T = rng.uniform(60, 365)
        lam, p = rng.gamma(2, 0.05), rng.beta(1, 5)
        t, times = 0.0, []
        while True:
            t += rng.exponential(1 / lam)
            if t > T:
                break
            times.append(t)
            if rng.random() < p:
                break
        x = max(len(times) - 1, 0)
        rec = times[-1] - times[0] if times else 0.0
        m = float(rng.gamma(5, 10)) if x > 0 else 0.0
        rows.append((i, x, float(rec), float(T), m))
    return spark.createDataFrame(rows, "customer_id long, frequency long, recency double, T double, monetary_value double")


def test_fit_and_predictions(spark):
    s = _population(spark).persist()
    bg = E.fit_bgnbd(s)
    gg = E.fit_gamma_gamma(s)
    assert all(v > 0 for v in bg.to_dict().values()) and bg.a >= 1.001 - 1e-12
    out = E.score(s, bg, gg, horizon=365.0, purchases_t=30.0).toPandas()
    assert (out.p_alive.between(0, 1)).all()
    assert (out[out.frequency == 0].p_alive == 1.0).all()
    assert np.isfinite(out.expected_purchases_30d).all() and (out.expected_purchases_30d >= 0).all()
    assert (out.clv_365d >= 0).all()
    # the fitted point is a local optimum of the penalised objective
    d = E.bgnbd_data(s)
    f0 = E.bgnbd_loglik(d, bg).first()[0] - 1e-3 * sum(v * v for v in bg.to_dict().values())
    for k in ("r", "alpha", "b"):
        for fac in (0.98, 1.02):
            p = bg.to_dict()
            p[k] *= fac
            f1 = E.bgnbd_loglik(d, M.BGNBDParams(**p)).first()[0] - 1e-3 * sum(v * v for v in p.values())
            assert f1 <= f0 + 1e-6


def test_horizon_monotone(spark):
    s = _population(spark, 120, 3)
    bg = M.BGNBDParams(0.8, 10.0, 1.5, 2.0)
    a = E.score(s, bg, purchases_t=30.0).select("customer_id", "expected_purchases_30d")
    b = E.score(s, bg, purchases_t=90.0).select("customer_id", "expected_purchases_90d")
    j = a.join(b, "customer_id").toPandas()
    assert (j.expected_purchases_90d >= j.expected_purchases_30d - 1e-12).all()


def test_invalid_inputs(spark):
    bad = spark.createDataFrame([(1, 1, 10.0, 5.0, 3.0)], "customer_id long, frequency long, recency double, T double, monetary_value double")
    with pytest.raises(ValueError):
        E.fit_bgnbd(bad)
    zero = spark.createDataFrame([(1, 3, 1.0, 5.0, 10.0), (2, 5, 1.0, 5.0, 0.0), (3, 2, 1.0, 5.0, 20.0)],
                                 "customer_id long, frequency long, recency double, T double, monetary_value double")
    with pytest.raises(ValueError):
        E.fit_gamma_gamma(zero)


def test_perturbation(spark):
    from patronage.operators.clv import uncertainty as U
    s = _population(spark, 80, 5)
    bg, gg = M.BGNBDParams(0.8, 10.0, 1.5, 2.0), M.GammaGammaParams(5.0, 4.0, 30.0)
    out = U.parameter_perturbation_clv(bg, gg, s, n_perturbations=50).toPandas()
    assert list(out.columns) == ["customer_id", "clv_mean", "clv_p05", "clv_p95", "clv_std"]
    assert (out.clv_p05 <= out.clv_mean + 1e-9).all() and (out.clv_mean <= out.clv_p95 + 1e-9).all()
    assert bg == M.BGNBDParams(0.8, 10.0, 1.5, 2.0)
    with pytest.raises(ValueError):
        U.parameter_perturbation_clv(bg, gg, s, relative_noise=0)
    with pytest.raises(ValueError):
        U.bootstrap_clv(s, n_bootstrap=5)
    with pytest.raises(ValueError):
        U.bootstrap_clv(s, alpha=1.5)


def _simulate_bgnbd(spark, n, r, alpha, a, b, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        T = float(rng.uniform(100, 400))
        lam, p = rng.gamma(r, 1.0 / alpha), rng.beta(a, b)
        t, times = 0.0, []
        while True:
            t += rng.exponential(1.0 / lam)
            if t > T:
                break
            times.append(t)
            if rng.random() < p:
                break
        rows.append((i, len(times), float(times[-1]) if times else 0.0, T, 1.0))
    return spark.createDataFrame(rows, "customer_id long, frequency long, recency double, T double, monetary_value double")


def test_fit_recovers_known_parameters(spark):
    true = M.BGNBDParams(r=0.5, alpha=5.0, a=2.5, b=4.0)
    s = _simulate_bgnbd(spark, 4000, true.r, true.alpha, true.a, true.b).persist()
    fit = E.fit_bgnbd(s)
    d = E.bgnbd_data(s)

    def objective(p):
        return -E.bgnbd_loglik(d, p).first()[0] + 1e-3 * sum(v * v for v in p.to_dict().values())
    assert objective(fit) <= objective(true) + 1e-6
    assert abs(fit.r - true.r) / true.r < 0.25 and abs(fit.alpha - true.alpha) / true.alpha < 0.35
