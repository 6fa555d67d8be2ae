import itertools

import numpy as np
import pytest

from patronage.operators.shapley import exact_shapley


def _scorer():
    def run(x):  # local, so that it travels to the workers by value
        return x[:, 0] * x[:, 1] + np.maximum(x[:, 2], 0.5) - 0.1 * x[:, 3] ** 2
    return run


score = _scorer()


def brute(row, base):
    d, out = len(row), np.zeros(len(row))
    orders = list(itertools.permutations(range(d)))
    for order in orders:
        z = base.copy()
        before = score(z).mean()
        for i in order:
            z[:, i] = row[i]
            after = score(z).mean()
            out[i] += after - before
            before = after
    return out / len(orders)


def test_values_equal_all_orders(spark):
    rng = np.random.default_rng(3)
    x, base = rng.normal(size=(40, 4)), rng.normal(size=(5, 4))
    rows = [(2**60 + i, *map(float, r)) for i, r in enumerate(x)] + [(1, None, 1.0, 1.0, 1.0), (2, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, c double, d double").repartition(3)
    got = {r.customer_id: r for r in exact_shapley(df, ["a", "b", "c", "d"], score, base).collect()}
    assert len(got) == 42 and got[1].shap_b is None and got[2].shap_a is None
    for i, row in enumerate(x):
        values = [got[2**60 + i][f"shap_{f}"] for f in "abcd"]
        assert np.allclose(values, brute(row, base))
        assert np.isclose(sum(values), score(row[None])[0] - score(base).mean())


def test_limits(spark):
    df = spark.createDataFrame([(1, 2.0)], "customer_id long, a double")
    with pytest.raises(ValueError):
        exact_shapley(df, ["a"] * 13, score, np.zeros((1, 13)))
    with pytest.raises(ValueError):
        exact_shapley(df, ["a"], score, np.zeros((0, 1)))
    assert exact_shapley(df.where("false"), ["a"], lambda x: x[:, 0], [[0.0]]).collect() == []
