"""Model explanations (M27-M29): permutation importance and per-customer
contributions, for every customer at once."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shuffle import targets
from ..storage import kept
from .metrics import auc_frame
from .rank import global_rank
from .supervised import Trained, with_probability


def contributions(df: DataFrame, features, weights: dict, means: dict | None = None, top_k: int = 5,
                  id_col: str = "customer_id") -> DataFrame:
    """weight x (value - mean) per feature, the ``top_k`` largest by absolute
    value as ARRAY<STRUCT<feature, value, contribution>> (M28). Means
    default to 0. A projection: no shuffle."""
    means = means or {}
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                      (F.lit(float(weights[f])) * (F.col(f).cast("double") - F.lit(float(means.get(f, 0.0)))))
                      .alias("contribution")) for f in features]
    ordered = F.array_sort(F.array(*items), lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                           .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1)
                           .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    return df.select(id_col, F.slice(ordered, 1, top_k).alias("top_features"))


def contributions_long(top: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """One row per (customer, rank) from ``contributions``."""
    return top.select(id_col, F.posexplode("top_features").alias("pos", "c")).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("c.feature").alias("feature"),
        F.col("c.value").alias("value"), F.col("c.contribution").alias("contribution"))


def model_weights(tr: Trained) -> dict:
    """Coefficients of linear models, importances of tree models."""
    return dict(tr.weights)


def linear_shap(tr: Trained, df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Exact SHAP values of a linear model with independent features on the
    model's (scaled) inputs: coefficient x (x - training mean), which is 0
    mean in scaled units. Computed for every row (M29, linear case)."""
    if not hasattr(tr.model, "coefficients"):
        raise TypeError("linear_shap needs a linear model")
    from pyspark.ml.functions import vector_to_array
    vec = tr.prep.apply(df)
    arr = vector_to_array("features")
    coef = tr.model.coefficients.toArray()
    return vec.select(id_col, *[(arr[i] * float(coef[i])).alias(f) for i, f in enumerate(tr.prep.features)])


def _grouped_score(scored: DataFrame, scoring: str, group: str | None = None) -> DataFrame:
    """roc_auc, accuracy or f1 per group (or overall) of a scored frame."""
    if scoring == "roc_auc":
        return auc_frame(scored, "label", "score", group=group).withColumnRenamed("roc_auc", "value")
    y = F.col("label").cast("int")
    p = (F.col("score") >= 0.5).cast("int")
    keys = [group] if group else []
    c = scored.groupBy(*keys).agg(F.sum((y * p)).alias("tp"), F.sum(((1 - y) * p)).alias("fp"),
                                  F.sum((y * (1 - p))).alias("fn"), F.count(F.lit(1)).alias("n"),
                                  F.sum(F.when(y == p, 1).otherwise(0)).alias("ok"))
    if scoring == "accuracy":
        return c.select(*keys, (F.col("ok") / F.col("n")).alias("value"))
    if scoring == "f1":
        den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
        return c.select(*keys, F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0).alias("value"))
    raise ValueError(f"unknown scoring: {scoring}")


def permutation_importance_of(df: DataFrame, features, target: str, rated, n_repeats: int = 10, seed: int = 0,
                              id_col: str = "customer_id", scoring: str = "roc_auc") -> DataFrame:
    """Drop in the score of any rating when one feature is shuffled (M27): importance_mean
    and importance_std (population) over ``n_repeats`` shuffles per feature.

    ``rated`` adds the column ``score`` to a frame with the features; ``scoring``
    is roc_auc, accuracy or f1 of it against ``target``. Features become doubles.

    Rows get positions in id order once. Shuffle g = (feature, repeat) is a keyed
    permutation of the positions, computed without a sort; only the shuffled
    value travels, in one equi-join on the position, and all shuffles are rated
    in one pass. Rows may share an id; a null value is shuffled like any other;
    no rows give no rows.
    """
    feats = list(features)
    base = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats], F.col(target).cast("double").alias("label"))
    base = kept(global_rank(base, [F.col(id_col)], "pos").withColumn("pos", F.col("pos") - 1))
    spark, n = df.sparkSession, base.count()
    out = []
    if n:
        sent = base.select(F.array(*feats).alias("own"), F.posexplode(targets("pos", n, len(feats) * n_repeats, seed)).alias("g", "pos"))
        fidx = (F.col("g") / n_repeats).cast("int")
        sent = sent.select("g", "pos", F.get("own", fidx).alias("__v"))
        # both sides grow with the table, however small its files: neither may be broadcast
        shuffled = sent.join(base.hint("merge"), "pos").select(id_col, "g", "label", *[
            F.when(fidx == i, F.col("__v")).otherwise(F.col(f)).alias(f) for i, f in enumerate(feats)])
        baseline = _grouped_score(rated(base.drop("pos")), scoring).first()["value"]
        drops: dict = {}
        for r in sorted(_grouped_score(rated(shuffled), scoring, "g").collect(), key=lambda r: r["g"]):  # one row a shuffle
            drops.setdefault(r["g"] // n_repeats, []).append(baseline - r["value"])
        out = [(feats[i], float(np.mean(v)), float(np.std(v))) for i, v in drops.items()]
    return (spark.createDataFrame(out, "feature string, importance_mean double, importance_std double")
            .orderBy(F.desc("importance_mean"), "feature"))


def permutation_importance(tr: Trained, df: DataFrame, target: str, n_repeats: int = 10,
                           seed: int = 0, id_col: str = "customer_id", scoring: str = "roc_auc") -> DataFrame:
    """``permutation_importance_of`` a trained model; one without class probabilities is
    scored by accuracy."""
    rated = with_probability
    if not hasattr(tr.model, "probabilityCol"):
        scoring, rated = "accuracy", lambda d: d.withColumn("score", F.col("prediction"))
    return permutation_importance_of(df, tr.prep.features, target, lambda d: rated(tr.model.transform(tr.prep.apply(d))),
                                     n_repeats, seed, id_col, scoring)


def shapley_sampling(tr: Trained, df: DataFrame, n_permutations: int = 10, background: int = 100,
                     seed: int = 0, id_col: str = "customer_id") -> DataFrame:
    """Monte-Carlo Shapley values of P(class 1) for any fitted model
    (Strumbelj and Kononenko 2014), for every row of ``df`` (M29).

    For each (row, permutation) a feature order and a background row are
    drawn by hash; the d + 1 coalition vectors along the order are exploded
    as rows, scored by one model transform, and consecutive differences are
    credited to the feature added at that step. A window over the d + 1 rows
    of one (row, permutation) and a grouped mean give the values. The
    background set (at most ``background`` rows, chosen by hash order) is
    broadcast. Output: id, one column per feature, and the base value
    (mean score of the background) as ``expected_value``.
    """
    from pyspark.sql import Window

    feats = list(tr.prep.features)
    d = len(feats)
    base = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats])
    bg = (base.withColumn("__h", F.xxhash64(F.col(id_col), F.lit(int(seed) + 17)))
          .orderBy("__h", id_col).limit(int(background))
          .select(*[F.col(f).alias(f"__z_{f}") for f in feats]))
    bg = bg.withColumn("__b", F.row_number().over(Window.orderBy(*[f"__z_{f}" for f in feats])) - 1)
    n_bg = bg.count()
    rows = (base.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
            .withColumn("__b", F.pmod(F.xxhash64(F.col(id_col), "__p", F.lit(int(seed))), F.lit(n_bg)))
            .join(F.broadcast(bg), "__b"))
    # position of each feature in this row's permutation
    keyed = F.array(*[F.struct(F.xxhash64(F.col(id_col), "__p", F.lit(j), F.lit(int(seed))).alias("h"),
                               F.lit(j).alias("j")) for j in range(d)])
    rows = rows.withColumn("__order", F.transform(F.array_sort(keyed), lambda s: s["j"]))
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    pos = {f: F.array_position(F.col("__order"), j) - 1 for j, f in enumerate(feats)}
    coal = rows.select(id_col, "__p", "__k", "__order",
                       *[F.when(pos[f] < F.col("__k"), F.col(f)).otherwise(F.col(f"__z_{f}")).alias(f) for f in feats])
    scored = with_probability(tr.model.transform(tr.prep.apply(coal)))
    w = Window.partitionBy(id_col, "__p").orderBy("__k")
    steps = (scored.select(id_col, "__p", "__k", "__order", "score")
             .withColumn("__diff", F.col("score") - F.lag("score").over(w))
             .where(F.col("__k") > 0)
             .withColumn("__feat", F.element_at(F.col("__order"), F.col("__k"))))
    vals = steps.groupBy(id_col).pivot("__feat", list(range(d))).agg(F.avg("__diff"))
    ev = with_probability(tr.model.transform(tr.prep.apply(
        bg.select(*[F.col(f"__z_{f}").alias(f) for f in feats])))).agg(F.avg("score").alias("expected_value"))
    from ..functions.scaling import attach_row
    return attach_row(vals.select(id_col, *[F.col(str(j)).alias(f) for j, f in enumerate(feats)]), ev)
