import numpy as np
import pytest

from patronage.operators.hierarchical import cut, hierarchical, merge_tree


def naive(x, k, linkage):
    clusters = [[i] for i in range(len(x))]

    def dist(a, b):
        pa, pb = x[a], x[b]
        d = np.sqrt(((pa[:, None, :] - pb[None, :, :]) ** 2).sum(axis=2))
        if linkage == "single":
            return d.min()
        if linkage == "complete":
            return d.max()
        if linkage == "average":
            return d.mean()
        ca, cb = pa.mean(axis=0), pb.mean(axis=0)
        return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()
    while len(clusters) > k:
        best = None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                d = dist(clusters[i], clusters[j])
                if best is None or d < best[0]:
                    best = (d, i, j)
        _, i, j = best
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]
    lab = np.empty(len(x), dtype=int)
    for c, members in enumerate(clusters):
        lab[members] = c
    return lab


def same_partition(a, b):
    pairs = {}
    for u, v in zip(a, b):
        if pairs.setdefault(u, v) != v:
            return False
    return len(set(pairs.values())) == len(pairs)


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_merge_tree_matches_naive(linkage):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.5, size=(15, 2)) for c in ([0, 0], [4, 0], [0, 4])])
    roots = cut(merge_tree(x, np.ones(len(x)), linkage), len(x), 3)
    assert same_partition(roots, naive(x, 3, linkage))


def test_spark_hierarchical_exact(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.4, size=(20, 3)) for c in ([0, 0, 0], [3, 0, 0], [0, 3, 0], [0, 0, 3])])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "customer_id long, a double, b double, c double")
    got = {r.customer_id: r.cluster for r in hierarchical(df, ["a", "b", "c"], 4, "ward").collect()}
    assert same_partition([got[i] for i in range(len(x))], naive(x, 4, "ward"))
