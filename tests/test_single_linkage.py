import numpy as np
import pandas as pd
import pytest

from patronage.operators.hierarchical import cut, merge_tree
from patronage.operators.single_linkage import forest, merges, single_linkage


def frame(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"customer_id": ids, "u": x[:, 0], "v": x[:, 1]}))


def prim(x):
    """Edges (height, a, b) of the minimum spanning tree, point by point."""
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    best = {q: (d[0, q], 0, q) for q in range(1, len(x))}
    out = []
    while best:
        p = min(best, key=best.get)
        out.append(best.pop(p))
        for q in best:
            best[q] = min(best[q], (d[p, q], min(p, q), max(p, q)))
    return sorted(out)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return np.r_[rng.normal(0, 1, (150, 2)), rng.normal(6, 0.2, (100, 2)), [[40.0, -3.0], [1000.0, 1000.0]]]


@pytest.mark.parametrize("chunk,finish", [(1024, 1_000_000), (16, 20)])
def test_merges_are_the_spanning_tree(spark, points, chunk, finish):
    """Blocks of 16 rows and Spark rounds down to 20 edges change nothing."""
    got = merges(frame(spark, points), ["u", "v"], chunk=chunk, finish=finish).toPandas()
    want = prim(points)
    assert sorted(zip(got.a, got.b)) == sorted((a, b) for _, a, b in want)
    assert np.allclose(np.sort(got.height), np.sqrt([w for w, _, _ in want]))


@pytest.mark.parametrize("k", [2, 5])
def test_labels_equal_the_naive_tree(spark, points, k):
    x = np.r_[points, points[:7]]  # repeated points
    got = single_linkage(frame(spark, x), ["u", "v"], n_clusters=k).toPandas().set_index("customer_id").cluster
    want = cut(merge_tree(x, np.ones(len(x)), "single"), len(x), k)
    assert len(got) == len(x)
    assert len(set(zip(got.loc[range(len(x))], want))) == k == got.nunique()
    assert list(got.value_counts().sort_index()) == sorted(got.value_counts(), reverse=True)


def test_ties_nulls_and_empty(spark):
    grid = np.array([[i, j] for i in range(5) for j in range(5)], float)  # all edges equal
    one = merges(frame(spark, grid), ["u", "v"]).toPandas()
    two = merges(frame(spark, grid).repartition(5), ["u", "v"], chunk=4, finish=0).toPandas()
    assert sorted(zip(one.a, one.b)) == sorted(zip(two.a, two.b)) == sorted((a, b) for _, a, b in prim(grid))
    missing = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 4.0), (3, 9.0, 4.0)], "customer_id long, u double, v double")
    assert {r.customer_id: r.cluster for r in single_linkage(missing, ["u", "v"], n_clusters=2).collect()} == {1: 0, 2: 0, 3: 1}
    assert single_linkage(missing.limit(0), ["u", "v"]).count() == 0
    with pytest.raises(ValueError):
        single_linkage(missing, ["u", "v"], n_clusters=3)


def test_the_inside_of_a_cluster_is_left_alone(spark):
    """Distances computed stay far below all pairs, with a far outlier too."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (4000, 2)), rng.normal(30, 1, (4000, 2)), [[1e6, 1e6]]]
    seen = spark.sparkContext.accumulator(0)
    got = single_linkage(frame(spark, x), ["u", "v"], n_clusters=3, chunk=256, seen=seen).toPandas()
    assert sorted(got.cluster.value_counts()) == [1, 4000, 4000]
    assert seen.value < len(x) ** 2 / 10


def test_forest_keeps_the_lightest_edges():
    w = np.array([3.0, 1.0, 2.0, 2.0])
    a, b = np.array([0, 0, 1, 5]), np.array([2, 1, 2, 6])
    at, nodes, root = forest(w, a, b, a, b)
    assert sorted(at) == [1, 2, 3]
    assert dict(zip(nodes, root)) == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5}


def test_labels_do_not_pass_the_driver(spark):
    """Component labels grow with the points: their joins are shuffles, however small the files."""
    from patronage.operators import single_linkage as module
    up = spark.createDataFrame([(i, i // 2) for i in range(8)], "c long, root long")
    rows = spark.createDataFrame([(i, i) for i in range(8)], "v long, ca long")
    plan = module._relabel(rows, up, "ca")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_components_open_few_boxes(spark):
    """Two long components side by side meet by their boxes: few distances, the same edge, and no files of a level stay."""
    import pathlib

    from patronage.session import ensure_checkpoint_dir
    rng = np.random.default_rng(3)
    x = np.c_[rng.uniform(0, 60, 6000), np.repeat([0.0, 1.0], 3000)]
    folder = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("kept-*"))
    seen = spark.sparkContext.accumulator(0)
    got = merges(frame(spark, x), ["u", "v"], chunk=256, seen=seen).toPandas()
    left = len(set(folder.glob("kept-*")) - before)
    low, high = np.arange(3000), np.arange(3000, 6000)
    d = (x[low, None, 0] - x[None, high, 0]) ** 2 + 1.0
    at = np.unravel_index(d.argmin(), d.shape)
    cross = got[(got.a < 3000) & (got.b >= 3000)]
    assert len(got) == 5999 and [(r.a, r.b) for r in cross.itertuples()] == [(low[at[0]], high[at[1]])]
    for ids in (low, high):  # along a line the tree links neighbours
        order = ids[np.argsort(x[ids, 0])]
        own = got[got.a.isin(ids) & got.b.isin(ids)]
        assert set(zip(own.a, own.b)) == {(min(p), max(p)) for p in zip(order.tolist(), order[1:].tolist())}
    assert seen.value < len(x) ** 2 / 40
    assert left <= 12
