import numpy as np
import pytest

from patronage.operators.dbscan import dbscan


def brute_dbscan(x, eps, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    nb = [np.nonzero(d[i] <= eps)[0] for i in range(n)]
    core = np.array([len(v) >= min_samples for v in nb])
    labels = np.full(n, -1)
    cur = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = cur
        stack = [i]
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = cur
                    stack.append(q)
        cur += 1
    return labels


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    blobs = [rng.normal(c, 0.35, size=(80, 3)) for c in ([0, 0, 0], [3, 3, 0], [0, 3, 3])]
    x = np.vstack(blobs + [rng.uniform(-2, 5, size=(60, 3))])
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, c double")
    for eps, ms, chunk in ((0.5, 5, 2048), (0.5, 5, 16), (0.8, 10, 40)):
        got = {r.customer_id: r.cluster for r in dbscan(df, ["a", "b", "c"], eps, ms, chunk=chunk).collect()}
        want = brute_dbscan(x, eps, ms)
        assert [got[i] for i in range(len(x))] == list(want)


@pytest.mark.parametrize("case", ["outlier", "half in one cell"])
def test_dbscan_distances(spark, case):
    """A far outlier does not widen the grid; a cell that holds half of the points is not compared inside."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 12, size=(1500, 2))
    if case == "outlier":
        x[0] = 1e6
    else:
        x[:750] = 6 + rng.uniform(0, 1e-3, size=(750, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "customer_id long, a double, b double")
    seen = spark.sparkContext.accumulator(0)
    got = {r.customer_id: r.cluster for r in dbscan(df, ["a", "b"], 0.4, 5, chunk=64, seen=seen).collect()}
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, 0.4, 5))
    assert 0 < seen.value < 0.6 * len(x) ** 2


def test_dbscan_full_cells_that_touch_at_their_edges(spark, monkeypatch):
    """Dense cells whose representatives are too far apart are joined by their facing points; a dense set is sent about once."""
    from patronage.operators import dbscan as module
    rng = np.random.default_rng(8)
    dense = [rng.normal(c, 0.01, size=(150, 2)) for c in ([0.02, 0.02], [0.68, 0.02], [1.6, 0.02], [3.0, 3.0])]
    edge = [rng.normal(c, 0.002, size=(8, 2)) for c in ([0.26, 0.02], [0.98, 0.02])]
    x = np.vstack(dense + edge)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "customer_id long, a double, b double")
    sent, meet = [], module.meetings

    def counted(*args, **kw):
        pairs, key = meet(*args, **kw)
        sent.append(pairs.count())
        return pairs, key

    monkeypatch.setattr(module, "meetings", counted)
    for eps in (0.4, 0.45):
        got = {r.customer_id: r.cluster for r in dbscan(df, ["a", "b"], eps, 5, chunk=64).collect()}
        assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, eps, 5))
    assert max(sent) < 3 * len(x)  # 18 copies of every point before
