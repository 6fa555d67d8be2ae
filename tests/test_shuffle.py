import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.functions.shuffle import permuted, targets
from patronage.operators import explain as EX


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 1000, 12345])
def test_permutations(n):
    for g in range(4):
        assert sorted(permuted(np.arange(n), n, g, 7).tolist()) == list(range(n))
    if n > 50:
        assert (permuted(np.arange(n), n, 0, 7) != permuted(np.arange(n), n, 1, 7)).mean() > 0.8
        assert (permuted(np.arange(n), n, 0, 7) != permuted(np.arange(n), n, 0, 8)).mean() > 0.8


def test_permutations_look_random():
    n, groups = 2000, 200
    x = np.arange(n)
    r = [np.corrcoef(x, permuted(x, n, g, 1))[0, 1] for g in range(groups)]
    assert abs(np.mean(r)) < 0.01 and 0.8 < np.std(r) * np.sqrt(n) < 1.25
    neighbours = np.mean([np.mean(np.abs(np.diff(permuted(x, n, g, 1))) == 1) for g in range(groups)])
    assert neighbours < 5 / n
    fixed = np.mean([np.sum(permuted(x, n, g, 1) == x) for g in range(groups)])
    assert 0.6 < fixed < 1.5


def test_targets_column(spark):
    got = {r.id: r.t for r in spark.range(77).select("id", targets("id", 77, 3, 2).alias("t")).collect()}
    for g in range(3):
        assert [got[i][g] for i in range(77)] == permuted(np.arange(77), 77, g, 2).tolist()
    with pytest.raises(ValueError):
        targets("id", 5, 1, -1)


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n, repeats = 300, 5
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (a + 0.3 * rng.normal(size=n) > 0).astype(int)
    ids = 2**60 + np.arange(n) * 3
    df = spark.createDataFrame([(int(i), float(u), float(v), int(w)) for i, u, v, w in zip(ids, a, b, y)],
                               "customer_id long, a double, b double, y int").repartition(5)
    got = EX.permutation_importance_of(df, ["a", "b"], "y", lambda d: d.withColumn("score", (F.col("a") > 0).cast("double")),
                                       repeats, 9, scoring="accuracy").collect()
    base = np.mean((a > 0) == y)
    for i, (name, x) in enumerate((("a", a), ("b", b))):
        drops = []
        for r in range(repeats):
            moved = {"a": a, "b": b}[name].copy()
            moved[permuted(np.arange(n), n, i * repeats + r, 9)] = x
            drops.append(base - np.mean(((moved if name == "a" else a) > 0) == y))
        row = next(x for x in got if x.feature == name)
        assert abs(row.importance_mean - np.mean(drops)) < 1e-12 and abs(row.importance_std - np.std(drops)) < 1e-12
    assert [x.feature for x in got] == ["a", "b"] and got[1].importance_mean == 0
    auc = EX.permutation_importance_of(df, ["a", "b"], "y", lambda d: d.withColumn("score", F.col("a")), 2, 9).collect()
    assert auc[0].feature == "a" and auc[0].importance_mean > 0.3 and auc[1].importance_mean == 0
    assert EX.permutation_importance_of(df.where("false"), ["a"], "y", lambda d: d.withColumn("score", F.col("a"))).collect() == []


def test_one_id_for_all_rows(spark):
    df = spark.createDataFrame([(5, float(i % 2), i % 2) for i in range(40)], "customer_id long, a double, y int")
    got = EX.permutation_importance_of(df, ["a"], "y", lambda d: d.withColumn("score", F.col("a")), 4, scoring="accuracy").first()
    assert 0.2 < got.importance_mean < 0.8


def test_importance_broadcasts_no_table(spark):
    """The rows meet their shuffled values by a shuffle, however small their files: a broadcast would pass the driver."""
    plans = []

    def rated(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return d.withColumn("score", F.col("a"))

    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(50)], "customer_id long, a double, y int")
    assert EX.permutation_importance_of(df, ["a"], "y", rated, 3, scoring="accuracy").count() == 1
    joined = [p for p in plans if "Join" in p]
    assert joined and all("SortMergeJoin" in p and "Broadcast" not in p for p in joined)
