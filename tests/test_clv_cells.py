import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators.clv import kernels as K
from patronage.operators.clv import models as M
from patronage.operators.clv.cells import cell_weights, poisson_cdf, summed, uniforms
from patronage.operators.clv.fit import maximize


@pytest.mark.parametrize("n", [1, 7, 600])
def test_cdf_is_poisson(n):
    low, cdf = poisson_cdf(n)
    for k in range(max(0, n - 20), n + 20):
        want = sum(math.exp(i * math.log(n) - n - math.lgamma(i + 1)) for i in range(k + 1))
        assert abs(cdf[k - low] - want) < 1e-9


def test_draws_of_a_hot_cell_have_its_mean_and_variance(spark):
    n, b = 40_000_000, 400
    df = spark.createDataFrame([(3, 1.5, n)], "x long, y double, n long")
    w = np.array(cell_weights(df, ["x", "y"], b, 7).first().weights)
    assert abs(w.mean() - n) < 5 * math.sqrt(n / b) and 0.7 < w.var() / n < 1.4
    low, cdf = poisson_cdf(n)
    assert (w == low + np.searchsorted(cdf, uniforms("3:1.5", b, 7), side="right")).all()


def test_array_weights_fit_as_exploded_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(x), int(x and rng.integers(1, 300)), 300 + int(rng.integers(0, 60)), 1) for x in rng.poisson(1.2, 150)]
    keys = ["frequency", "recency", "T"]
    df = spark.createDataFrame(rows, "frequency long, recency long, T long, one long").repartition(3)
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    arrays = summed(cell_weights(cells, keys, 2, 5), keys, 2).persist()
    plain = arrays.select(*keys, F.posexplode("weights").alias("replicate", "w")).where("w > 0")
    starts = {b: [np.array([0.5, 50.0, 0.8, 2.0])] for b in (0, 1)}
    got, want = (maximize(d, K.bgnbd, keys, M.BGNBD_NAMES, starts, M.BGNBD_LOWER, M.BGNBD_UPPER, 1e-3) for d in (arrays, plain))
    assert set(got) == set(want) == {0, 1}
    for b in got:
        assert np.allclose(got[b].theta, want[b].theta, rtol=1e-4)


def test_kernels_evaluate_a_count_once(monkeypatch):
    """Log-gamma and digamma of many rows with few purchase counts cost as many values as there are counts."""
    import numpy as np

    from patronage.operators.clv import kernels as K
    rng = np.random.default_rng(1)
    x = rng.integers(1, 9, 4000).astype(float)
    tx, T, m = rng.uniform(0, 300, 4000), rng.uniform(300, 700, 4000), rng.uniform(5, 90, 4000)
    sizes = []
    for name in ("lg", "psi"):
        f = getattr(K, name)
        monkeypatch.setattr(K, name, lambda z, f=f: (sizes.append(np.size(z)), f(z))[1])
    for kernel, cols, theta in ((K.bgnbd, (x, tx, T), [[0.4, 30.0, 0.8, 2.5], [1.1, 9.0, 1.4, 3.0]]),
                                (K.gamma_gamma, (x, m), [[2.0, 3.5, 40.0], [6.0, 3.0, 15.0]])):
        ll, grads = kernel([c[None, :] for c in cols], np.array(theta))
        for i in (0, 7, 3999):  # a row on its own
            one, own = kernel([c[None, i:i + 1] for c in cols], np.array(theta))
            assert np.allclose(ll[:, i], one[:, 0], rtol=1e-13) and all(np.allclose(g[:, i], o[:, 0], rtol=1e-12) for g, o in zip(grads, own))
    assert max(sizes) <= 2 * 8
