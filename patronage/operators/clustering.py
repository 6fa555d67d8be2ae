"""Customer clustering (M2-M8, A7-A9): K-means with restarts, quality
indices, k search, PCA projection, profiles."""
from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.scaling import attach_row
from ..storage import kept
from . import kmeans_chains as KC
from .features import prepare


def _points(df: DataFrame, cols, id_col: str) -> DataFrame:
    """Prepared features (vector, and ``__p`` as an array), written once: every iteration reads them."""
    vec, _ = prepare(df.select(id_col, *cols), cols)
    return kept(vec.withColumn("__p", vector_to_array("features")))


def kmeans_labels(df: DataFrame, cols, k: int = 4, n_init: int = 10, seed: int = 42, id_col: str = "customer_id"):
    """Prepared features + cluster label per row, by K-means from ``n_init`` seeds that
    keeps the least inertia (M2). Returns (frame, inertia)."""
    points = _points(df, cols, id_col)
    fits = KC.fit(points, [(k, seed + i) for i in range(n_init)], "__p", id_col)
    if not fits:  # no rows
        return points.withColumn("cluster", F.lit(None).cast("long")).drop("__p"), 0.0
    cost, centres, _ = KC.best(fits, k)
    return points.withColumn("cluster", KC.nearest("__p", centres)[0]).drop("__p"), cost


def _centroids(labelled: DataFrame, cols, label: str) -> DataFrame:
    """Per cluster: size, centroid and mean squared norm; one grouped aggregate."""
    norm2 = sum(F.col(c) ** 2 for c in cols)
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_k"), F.avg(norm2).alias("q_k"),
                                       *[F.avg(c).alias(f"{c}__c") for c in cols])


def quality_indices(labelled: DataFrame, cols, label: str = "cluster") -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and inertia (M4b-M4d) on the given
    (already scaled) columns; one row. Calinski-Harabasz and inertia come
    from the sums of each cluster; the mean distances that Davies-Bouldin
    needs take one more pass. Only cluster rows are paired, never data rows.
    An undefined index (one cluster, equal centroids) is null."""
    cent = (_centroids(labelled, cols, label))
    per = labelled.join(cent.select(label, *[f"{c}__c" for c in cols]), label)
    dist2 = sum((F.col(c) - F.col(f"{c}__c")) ** 2 for c in cols)
    per = per.groupBy(label).agg(F.sum(dist2).alias("w_k"), F.avg(F.sqrt(dist2)).alias("s_k"))
    rows = (cent.join(per, label))
    total = rows.agg(F.sum("n_k").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w_k").alias("W"),
                     *[(F.sum(F.col("n_k") * F.col(f"{c}__c")) / F.sum("n_k")).alias(f"{c}__g") for c in cols])
    between = attach_row(rows, total).agg(
        F.sum(F.col("n_k") * sum((F.col(f"{c}__c") - F.col(f"{c}__g")) ** 2 for c in cols)).alias("B"),
        F.first("W").alias("W"), F.first("k").alias("k"), F.first("n").alias("n"))
    ch = between.select(F.try_divide(F.try_divide(F.col("B"), F.col("k") - 1),
                                     F.try_divide(F.col("W"), F.col("n") - F.col("k"))).alias("calinski_harabasz"),
                        F.col("W").alias("inertia"))
    a = rows.select(F.col(label).alias("la"), "s_k", *[F.col(f"{c}__c").alias(f"{c}__a") for c in cols])
    b = rows.select(F.col(label).alias("lb"), F.col("s_k").alias("s_j"), *[F.col(f"{c}__c").alias(f"{c}__b") for c in cols])
    pairs = a.join(b, F.col("la") != F.col("lb"))  # clusters with clusters
    dij = F.sqrt(sum((F.col(f"{c}__a") - F.col(f"{c}__b")) ** 2 for c in cols))
    db = (pairs.groupBy("la").agg(F.max(F.try_divide(F.col("s_k") + F.col("s_j"), dij)).alias("r"))
          .agg(F.avg("r").alias("davies_bouldin")))
    return attach_row(ch, db)


def silhouette(labelled: DataFrame, cols, label: str = "cluster") -> DataFrame:
    """Mean silhouette under squared Euclidean distance (M4a), one row.

    The mean squared distance of a point to a cluster follows from the
    cluster's size, centroid and mean squared norm, so every point is
    compared with every cluster's summary and with no other point: exact and
    linear at every size. It differs from the Euclidean silhouette, which
    needs all pairs. A cluster of one point counts 0, one cluster gives null.
    """
    cent = _centroids(labelled, cols, label).select(
        F.struct(F.col(label).alias("l"), "n_k", "q_k", *[F.col(f"{c}__c").alias(f"c{i}") for i, c in enumerate(cols)]).alias("k"))
    every = cent.agg(F.collect_list("k").alias("ks"))  # one row a cluster
    norm2 = sum(F.col(c) ** 2 for c in cols)

    def mean2(k):
        return F.greatest(F.lit(0.0), norm2 + k["q_k"] - 2 * sum(F.col(c) * k[f"c{i}"] for i, c in enumerate(cols)))

    x = attach_row(labelled.select(F.col(label).alias("__l"), *cols), every)
    own = F.filter("ks", lambda k: k["l"] == F.col("__l"))[0]
    a = mean2(own) * F.try_divide(own["n_k"], own["n_k"] - 1)  # without the point itself
    b = F.array_min(F.transform(F.filter("ks", lambda k: k["l"] != F.col("__l")), mean2))
    s = F.when(b.isNull(), None).when(own["n_k"] == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return x.select(s.alias("s")).agg(F.avg("s").alias("silhouette"))


def k_search(df: DataFrame, cols, k_values=range(2, 11), n_init: int = 10, seed: int = 42,
             id_col: str = "customer_id") -> DataFrame:
    """Silhouette, Davies-Bouldin, Calinski-Harabasz and inertia per k (M3)."""
    spark = df.sparkSession
    points = _points(df, cols, id_col)
    xs = [f"__x{i}" for i in range(len(cols))]
    k_values = [int(k) for k in k_values]
    fits = KC.fit(points, [(k, seed + i) for k in k_values for i in range(n_init)], "__p", id_col)
    rows = []
    if fits:
        found = [KC.best(fits, k) for k in k_values]
        labelled = kept(points.select(*[F.col("__p")[i].alias(x) for i, x in enumerate(xs)],
                                      KC.nearest("__p", *[c for _, c, _ in found]).alias("labels")))
        for i, k in enumerate(k_values):
            lab = labelled.select(*xs, F.col("labels")[i].alias("cluster"))
            q = quality_indices(lab, xs).first()
            sil = silhouette(lab, xs).first()["silhouette"]
            rows.append((k, sil, q["davies_bouldin"], q["calinski_harabasz"], float(found[i][0])))
    schema = StructType([StructField("k", LongType()), StructField("silhouette", DoubleType()),
                         StructField("davies_bouldin", DoubleType()), StructField("calinski_harabasz", DoubleType()),
                         StructField("inertia", DoubleType())])
    return spark.createDataFrame(rows, schema)


def _with_labels(df: DataFrame, labels: DataFrame | None, id_col: str, label: str) -> DataFrame:
    """df with the label of each id; without ``labels`` it has its own."""
    return df if labels is None else df.drop(label).join(labels.select(id_col, label), id_col)


def cluster_profiles(df: DataFrame, labels: DataFrame | None, cols, id_col: str = "customer_id",
                     label: str = "cluster") -> DataFrame:
    """Mean of each feature and size per cluster (A8), on original units."""
    j = _with_labels(df, labels, id_col, label)
    return j.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("count"))


def cluster_statistics(df: DataFrame, labels: DataFrame | None, cols, id_col: str = "customer_id",
                       label: str = "cluster") -> DataFrame:
    """Mean, sample std and non-null count per feature and cluster."""
    j = _with_labels(df, labels, id_col, label)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    return j.groupBy(label).agg(*aggs)


def radar(profiles: DataFrame, df: DataFrame, cols, label: str = "cluster") -> DataFrame:
    """(profile - global min) / (global max - min + 1e-10) per feature."""
    mm = df.agg(*[F.min(c).alias(f"{c}__min") for c in cols], *[F.max(c).alias(f"{c}__max") for c in cols])
    j = attach_row(profiles, mm)
    return j.select(label, *[((F.col(c) - F.col(f"{c}__min")) / (F.col(f"{c}__max") - F.col(f"{c}__min") + 1e-10)).alias(c)
                             for c in cols])


def pca_projection(vec_labelled: DataFrame, n_features: int, keep=("customer_id", "cluster")) -> DataFrame:
    """First two principal components of the scaled features (M7). The
    largest loading of each component is made positive (sign is arbitrary)."""
    model = PCA(k=2, inputCol="features", outputCol="__pc").fit(vec_labelled)
    pc = model.pc.toArray().copy()
    for j in range(2):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    arr = vector_to_array("features")
    comps = [sum(arr[i] * float(pc[i, j]) for i in range(n_features)).alias(f"PC{j + 1}") for j in range(2)]
    return vec_labelled.select(*keep, *comps)


def scatter(df: DataFrame, labels: DataFrame, f1: str, f2: str, id_col: str = "customer_id",
            label: str = "cluster") -> DataFrame:
    """Two chosen features with the cluster label (M8)."""
    return df.select(id_col, f1, f2).join(labels.select(id_col, label), id_col)
