import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import clustering as CL
from patronage.operators import kmeans_chains as KC


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, x)], "customer_id long, x array<double>")


def blobs(seed=3, n=60):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, size=(n + 10 * i, 2)) for i, c in enumerate(([0, 0], [6, 0], [0, 6]))])


def test_step_equals_numpy(spark):
    x = blobs()
    c = np.array([[0.0, 1.0], [5.0, 5.0], [0.0, 1.0], [90.0, 90.0]])
    n, new, cost = KC.step(frame(spark, x).repartition(5), "x", c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    assert n.tolist() == np.bincount(near, minlength=4).tolist() and n[2] == n[3] == 0  # ties: the first; empty ones stay
    assert np.allclose(new[0], x[near == 0].mean(axis=0)) and np.allclose(new[3], c[3])
    assert abs(cost - d.min(axis=1).sum()) < 1e-8


def test_all_chains_find_the_blobs(spark):
    x = blobs()
    fits = KC.fit(frame(spark, x).repartition(4), [(k, s) for k in (1, 2, 3) for s in range(3)], "x")
    cost, centres, sizes = KC.best(fits, 3)
    assert sizes.tolist() == [80, 70, 60]
    assert np.allclose(centres, [x[130:].mean(axis=0), x[60:130].mean(axis=0), x[:60].mean(axis=0)])
    assert abs(cost - sum(((b - b.mean(axis=0)) ** 2).sum() for b in (x[:60], x[60:130], x[130:]))) < 1e-8
    assert abs(KC.best(fits, 1)[0] - ((x - x.mean(axis=0)) ** 2).sum()) < 1e-8
    assert cost < KC.best(fits, 2)[0] < KC.best(fits, 1)[0]
    assert cost == min(fits[(3, s)][0] for s in range(3))


def test_chains_do_not_depend_on_each_other_or_on_partitions(spark):
    df = frame(spark, blobs(5))
    alone = KC.fit(df.coalesce(1), [(3, 7)], "x")[(3, 7)]
    among = KC.fit(df.repartition(7), [(2, 7), (3, 1), (3, 7)], "x")[(3, 7)]
    assert np.allclose(alone[1], among[1]) and abs(alone[0] - among[0]) < 1e-8


@pytest.mark.parametrize("points,k,expected", [
    ([], 2, None), ([[1.0, 2.0]], 3, [1]), ([[0.0, 0.0]] * 40 + [[1.0, 1.0]] * 20, 4, [40, 20])])
def test_few_points(spark, points, k, expected):
    ids = [5] * len(points)  # one id for all rows
    fits = KC.fit(frame(spark, points, ids), [(k, s) for s in range(2)], "x")
    assert fits == {} if expected is None else all(n.tolist() == expected and c == 0 for c, _, n in fits.values())


def test_k_search_counts_and_jobs(spark):
    x = blobs(9)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "customer_id long, a double, b double")
    rows = CL.k_search(df, ["a", "b"], range(2, 5), n_init=4).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4]
    assert max(rows, key=lambda r: r.silhouette).k == 3 and max(rows, key=lambda r: r.calinski_harabasz).k == 3
    assert rows[0].inertia > rows[1].inertia > rows[2].inertia
    labels, cost = CL.kmeans_labels(df, ["a", "b"], 3, 4)
    assert abs(cost - rows[1].inertia) < 1e-8
    assert [r.n for r in labels.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()] == [80, 70, 60]
    assert CL.kmeans_labels(df.where("false"), ["a", "b"], 3, 2)[0].collect() == []
    assert CL.k_search(df.where("false"), ["a", "b"], range(2, 4), n_init=2).collect() == []


def test_starts_keep_candidates_few(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.normal(size=(3000, 2))).repartition(6)
    drawn = {}
    scan = KC._scan

    def seen(points, features, chains):
        for s, c in chains.items():
            drawn[s] = max(drawn.get(s, 0), len(c))
        return scan(points, features, chains)

    KC._scan = seen
    try:
        KC.starts(df, [(5, s) for s in range(6)], "x", "customer_id")
    finally:
        KC._scan = scan
    assert max(drawn.values()) < 12 * 5
