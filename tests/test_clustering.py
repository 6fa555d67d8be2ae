import numpy as np
from pyspark.sql import functions as F

from patronage.operators import clustering as CL
from patronage.operators import features as FE


def _frame(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.6, size=(n // 3, 3)) for c in ([0, 0, 0], [3, 1, 0], [0, 3, 2])])
    lab = np.repeat([0, 1, 2], n // 3)
    df = spark.createDataFrame([(i, int(l), *map(float, p)) for i, (l, p) in enumerate(zip(lab, x))],
                               "customer_id long, cluster long, a double, b double, c double")
    return df, x, lab


def test_quality_indices_against_numpy(spark):
    df, x, lab = _frame(spark)
    q = CL.quality_indices(df, ["a", "b", "c"]).first()
    k, n = 3, len(x)
    c = np.array([x[lab == j].mean(axis=0) for j in range(k)])
    g = x.mean(axis=0)
    W = sum(((x[lab == j] - c[j]) ** 2).sum() for j in range(k))
    B = sum((lab == j).sum() * ((c[j] - g) ** 2).sum() for j in range(k))
    assert abs(q.calinski_harabasz - (B / (k - 1)) / (W / (n - k))) < 1e-8 * q.calinski_harabasz
    s = np.array([np.sqrt(((x[lab == j] - c[j]) ** 2).sum(axis=1)).mean() for j in range(k)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(k) if j != i) for i in range(k)])
    assert abs(q.davies_bouldin - db) < 1e-10 and abs(q.inertia - W) < 1e-8


def test_squared_silhouette_against_brute_force(spark):
    df, x, lab = _frame(spark, 90, 1)
    got = CL.silhouette(df, ["a", "b", "c"]).first().silhouette
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == j].mean() for j in set(lab) if j != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-10


def test_prepare_scales_and_fills(spark):
    rows = [(i, float(i) if i != 0 else None, float(i % 7) if i != 1 else None, float(i * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "customer_id long, recency double, frequency double, monetary double")
    vec, _ = FE.prepare(df, ["recency", "frequency", "monetary"])
    pdf = vec.select("recency", "frequency", "monetary").toPandas()
    assert not pdf.isna().any().any()
    assert np.allclose(pdf.mean(), 0, atol=1e-9) and np.allclose(pdf.std(ddof=0), 1, atol=1e-9)


def test_kmeans_labels_ordered_by_size(spark):
    df, _, _ = _frame(spark, 150, 2)
    lab, cost = CL.kmeans_labels(df.drop("cluster"), ["a", "b", "c"], k=3, n_init=3)
    sizes = [r["n"] for r in lab.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and cost > 0
