import numpy as np
import pytest

from patronage.operators.features import folds
from patronage.operators.linear_cv import coefficients, cross_validate_linear, fold_moments, merged


def brute(x, y, fold, k, alpha):
    tr = fold != k
    m, s = x[tr].mean(axis=0), x[tr].std(axis=0)
    s = np.where(s > 0, s, 1.0)
    z = (x[tr] - m) / s
    w = np.linalg.lstsq(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y[tr] - y[tr].mean()), rcond=1e-12)[0]
    e = y[~tr] - y[tr].mean() - ((x[~tr] - m) / s) @ w
    return 1 - (e ** 2).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum(), np.sqrt((e ** 2).mean())


@pytest.mark.parametrize("alpha", [0.0, 25.0])
def test_scores_equal_refitted_models(spark, alpha):
    rng = np.random.default_rng(7)
    x = np.c_[rng.normal(1e7, 3.0, 300), rng.gamma(2, 50, 300), np.full(300, 4.0)]  # a large mean, a constant
    x = np.c_[x, x[:, 1] * 2 + 1]  # a collinear one
    y = 3 * (x[:, 0] - 1e7) - 0.2 * x[:, 1] + rng.normal(0, 2, 300)
    df = spark.createDataFrame([(2**60 + i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "customer_id long, a double, b double, c double, d double, y double").repartition(7)
    at = {r.customer_id - 2**60: r.fold for r in folds(df, "customer_id", 5, 43).collect()}
    fold = np.array([at[i] for i in range(300)])
    got = {r.fold: r for r in cross_validate_linear(df, ["a", "b", "c", "d"], "y", alpha=alpha).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k, r in got.items():
        assert (r.n_train, r.n_test) == ((fold != k).sum(), (fold == k).sum())
        assert np.allclose((r.r2, r.rmse), brute(x, y, fold, k, alpha), rtol=1e-6)


def test_moments_merge_and_missing_values_raise(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(5, 2, 90), rng.normal(0, 1, 90)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "fold int, x double, y double")
    n, mean, c = merged(fold_moments(df, ["x"], "y").values())
    assert n == 90 and np.allclose(mean, [x.mean(), y.mean()]) and np.allclose(c, np.cov(x, y, ddof=0))
    intercept, w = coefficients((n, mean, c))
    assert np.allclose([intercept, w[0]], np.polyfit(x, y, 1)[::-1])
    with pytest.raises(ValueError):
        fold_moments(df.union(spark.createDataFrame([(0, float("nan"), 1.0)], df.schema)), ["x"], "y")
