"""Lifetime-value regression and churn classification on Spark ML
(M9-M26, P5, P6, T1-T3).

Preparation is fitted on the training part only (medians, means and
population deviations), then applied to both parts and to scoring data.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.scaling import nan_to_null
from .features import assemble, folds, split, standardize
from .metrics import classification_metrics, regression_metrics
from .order_stats import quantiles


@dataclass
class Prepared:
    features: list
    medians: dict
    stats: DataFrame

    def apply(self, df: DataFrame) -> DataFrame:
        scaled, _ = standardize(_filled(df, self.features, self.medians), self.features, 0, self.stats)
        return assemble(scaled, self.features)


def _filled(df: DataFrame, cols, medians: dict) -> DataFrame:
    out = nan_to_null(df.withColumns({c: F.col(c).cast("double") for c in cols}), cols)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def fit_preparation(train: DataFrame, features) -> Prepared:
    """Exact medians and population deviations of the training rows."""
    cols = list(features)
    typed = nan_to_null(train.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    medians = {c: q[0] for c, q in quantiles(typed, cols, [0.5]).items()}
    row = _filled(typed, cols, medians).agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                                            *[F.stddev_pop(c).alias(f"{c}__s") for c in cols])
    stats = row.sparkSession.createDataFrame([tuple(row.first())], row.schema)  # one row
    return Prepared(cols, medians, stats)


@dataclass
class Trained:
    name: str
    model: object
    prep: Prepared
    metrics: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)


def _weights(model, features) -> dict:
    if hasattr(model, "featureImportances"):
        return dict(zip(features, map(float, model.featureImportances.toArray())))
    if hasattr(model, "coefficients"):
        return dict(zip(features, map(float, model.coefficients.toArray())))
    raise TypeError(f"cannot extract feature weights from {type(model).__name__}")


def _depth(max_depth: int | None) -> int:
    """None (unlimited) is 30, where Spark's trees end: a billion leaves; an explicit depth beyond is refused, not cut."""
    if max_depth is None:
        return 30
    if max_depth > 30:
        raise ValueError("max_depth must be at most 30")
    return max_depth


#: Rows a task of a model fit reads, where there are more than two tasks a core.
FIT_ROWS = 100_000


def held(vec: DataFrame, n: int) -> DataFrame:
    """The ``n`` prepared rows in memory, in no more tasks than cores and rows ask for.

    Trees and boosting scan them in hundreds of short stages, whose time is that of
    their tasks: a shuffle's many small partitions would each be one, every time.
    """
    tasks = max(2 * vec.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FIT_ROWS))
    return (vec.coalesce(tasks) if vec.rdd.getNumPartitions() > tasks else vec).persist()


# ------------------------------------------------------------ regression --

def regressor(name: str, n_train: int, y_std: float, alpha: float = 1.0, n_estimators: int = 100,
              max_depth: int = 10, learning_rate: float = 0.1, seed: int = 42):
    if name == "ridge":
        # ridge on the sklearn scale: regParam = alpha * std_pop(y) / n
        return LinearRegression(regParam=alpha * y_std / max(n_train, 1), elasticNetParam=0.0,
                                standardization=False, solver="normal")
    if name in ("linear", "least_squares"):
        return LinearRegression(regParam=0.0, standardization=False, solver="normal")
    if name == "random_forest":
        return RandomForestRegressor(numTrees=n_estimators, maxDepth=_depth(max_depth),
                                     featureSubsetStrategy="all", seed=seed)
    if name == "gradient_boosting":
        return GBTRegressor(maxIter=n_estimators, stepSize=learning_rate, maxDepth=3, seed=seed)
    raise ValueError(f"unknown model type: {name}")


def train_regressions(df: DataFrame, features, target: str = "ltv", id_col: str = "customer_id",
                      names=("linear",), test_size: float = 0.2, seed: int = 42, **kw) -> list[Trained]:
    """One model a name, on one split and one preparation."""
    d = split(df.select(id_col, *features, F.col(target).cast("double").alias("label")), id_col, test_size, seed)
    prep = fit_preparation(d.where(~F.col("is_test")), features)
    vec = held(prep.apply(d), df.count())
    tr = vec.where(~F.col("is_test"))
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    out = []
    for name in names:
        model = regressor(name, st["n"], float(st["s"] or 0.0), seed=seed, **kw).fit(tr)
        pred = model.transform(vec).withColumn("part", F.when(F.col("is_test"), "test").otherwise("train"))
        m = {r["part"]: r for r in regression_metrics(pred, group="part").collect()}
        metrics = {f"{p}_{k}": float(m[p][k]) for p in ("train", "test") if p in m for k in ("rmse", "mae", "r2")}
        out.append(Trained(name, model, prep, metrics, _weights(model, features)))
    vec.unpersist()
    return out


def train_regression(df: DataFrame, features, target: str = "ltv", id_col: str = "customer_id",
                     name: str = "linear", test_size: float = 0.2, seed: int = 42, **kw) -> Trained:
    return train_regressions(df, features, target, id_col, [name], test_size, seed, **kw)[0]


def predict(tr: Trained, df: DataFrame, keep=("customer_id",), out: str = "prediction") -> DataFrame:
    """Score new rows with the training preparation."""
    return tr.model.transform(tr.prep.apply(df)).select(*keep, F.col("prediction").alias(out))


# -------------------------------------------------------- classification --

def classifier(name: str, n_train: int, C: float = 1.0, n_estimators: int = 100, max_depth: int = 10,
               learning_rate: float = 0.1, balanced: bool = True, seed: int = 42):
    w = {"weightCol": "w"} if balanced else {}
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (C * max(n_train, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000, tol=1e-8, **w)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=n_estimators, maxDepth=_depth(max_depth),
                                      featureSubsetStrategy="sqrt", seed=seed, **w)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=3, seed=seed)
    raise ValueError(f"unknown model type: {name}")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """w = n / (2 n_class): sklearn's 'balanced' class weight."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = cnt.agg(F.sum("__nc").alias("__n"))
    cw = cnt.withColumn("__one", F.lit(1)).join(tot.withColumn("__one", F.lit(1)), "__one")
    cw = cw.select(label, (F.col("__n") / (2.0 * F.col("__nc"))).alias("w"))
    return df.join(F.broadcast(cw), label)


def with_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", vector_to_array("probability")[1])


def train_classifiers(df: DataFrame, features, target: str = "churn", id_col: str = "customer_id",
                      names=("logistic_regression",), test_size: float = 0.2, seed: int = 42,
                      threshold: float = 0.5, **kw) -> list[Trained]:
    """One model a name, on one split and one preparation."""
    d = split(df.select(id_col, *features, F.col(target).cast("double").alias("label")), id_col, test_size, seed,
              exact=True, stratify="label")
    prep = fit_preparation(d.where(~F.col("is_test")), features)
    vec = held(balanced_weights(prep.apply(d), "label"), df.count())
    tr = vec.where(~F.col("is_test"))
    n = tr.count()
    out = []
    for name in names:
        model = classifier(name, n, seed=seed, **kw).fit(tr)
        test = with_probability(model.transform(vec.where(F.col("is_test"))))
        test = test.withColumn("prediction", (F.col("score") >= threshold).cast("double"))
        m = classification_metrics(test).first().asDict()
        out.append(Trained(name, model, prep, {k: None if v is None else float(v) for k, v in m.items()}, _weights(model, features)))
    vec.unpersist()
    return out


def train_classifier(df: DataFrame, features, target: str = "churn", id_col: str = "customer_id",
                     name: str = "logistic_regression", test_size: float = 0.2, seed: int = 42,
                     threshold: float = 0.5, **kw) -> Trained:
    return train_classifiers(df, features, target, id_col, [name], test_size, seed, threshold, **kw)[0]


def churn_probability(tr: Trained, df: DataFrame, keep=("customer_id",)) -> DataFrame:
    """P(churn) per row."""
    return with_probability(tr.model.transform(tr.prep.apply(df))).select(*keep, F.col("score").alias("churn_probability"))


def decide(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """0/1 decision churn_probability >= threshold (P6); no probability, no decision."""
    return scored.withColumn("churn_prediction", (F.col("churn_probability") >= threshold).cast("int"))


def predict_churn(tr: Trained, df: DataFrame, threshold: float = 0.5, keep=("customer_id",)) -> DataFrame:
    """The decision of a fitted model for each row."""
    return decide(churn_probability(tr, df, keep), threshold)


def at_risk(scored: DataFrame, threshold: float = 0.7, id_col: str = "customer_id") -> DataFrame:
    """Rows with churn_probability >= threshold, highest first (P5)."""
    return scored.where(F.col("churn_probability") >= threshold).orderBy(F.desc("churn_probability"), id_col)


def high_risk(tr: Trained, df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Customers at risk by a fitted model."""
    return at_risk(churn_probability(tr, df, keep=df.columns), threshold)


# ---------------------------------------------------------- comparisons --

def comparison(trained, kind: str = "regression") -> DataFrame:
    """Model comparison table (M16), sorted by test R^2 or ROC-AUC."""
    spark = trained[0].prep.stats.sparkSession
    if kind == "regression":
        cols = ["test_rmse", "test_mae", "test_r2", "train_r2"]
        sort = "test_r2"
    else:
        cols = ["accuracy", "precision", "recall", "f1", "roc_auc"]
        sort = "roc_auc"
    schema = StructType([StructField("model", StringType())] + [StructField(c, DoubleType()) for c in cols])
    rows = [(t.name, *[t.metrics.get(c) for c in cols]) for t in trained]
    return spark.createDataFrame(rows, schema).orderBy(F.desc(sort))


def held_out_predictions(trained: Trained, df: DataFrame, target: str = "ltv", id_col: str = "customer_id",
                          test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """(id, actual, predicted) of the rows that the model was not fitted on (M17); the split is that of the training."""
    test = split(df, id_col, test_size, seed).where("is_test")
    return predict(trained, test, keep=(id_col, target)).select(
        id_col, F.col(target).cast("double").alias("actual"), F.col("prediction").alias("predicted"))


def importance(trained, top_n: int = 10) -> DataFrame:
    """Top-N feature weights (T3): random forest first, then boosting, then
    absolute linear coefficients."""
    by = {t.name: t for t in trained}
    pick = by.get("random_forest") or by.get("gradient_boosting") or \
        by.get("linear") or by.get("ridge") or by.get("logistic_regression") or trained[0]
    w = pick.weights
    if pick.name in ("linear", "ridge", "logistic_regression", "least_squares"):
        w = {k: abs(v) for k, v in w.items()}
    spark = pick.prep.stats.sparkSession
    rows = sorted(w.items(), key=lambda kv: -kv[1])[:top_n]
    return spark.createDataFrame(rows, "feature string, importance double").withColumn("model", F.lit(pick.name))


def _number(x) -> float:
    return float("nan") if x is None else float(x)


def cross_validate(df: DataFrame, features, target: str, id_col: str = "customer_id", name: str = "linear",
                   cv: int = 5, seed: int = 42, kind: str = "regression", **kw) -> dict:
    """K-fold CV (M14/M22), stratified by the label for classification;
    preparation is refitted on each training part. ``kw`` goes to the model;
    a score that a fold leaves undefined is NaN and left out of the means. Returns per-fold scores, means and population
    deviations."""
    import numpy as np
    base = folds(df.select(id_col, *features, F.col(target).cast("double").alias("label")), id_col, cv, seed + 1,
                 stratify=None if kind == "regression" else "label").persist()
    first, second = [], []
    for k in range(cv):
        d = base.withColumn("is_test", F.col("fold") == k)
        tr = d.where(~F.col("is_test"))
        prep = fit_preparation(tr, features)
        vec = prep.apply(d)
        trv = vec.where(~F.col("is_test"))
        if kind == "regression":
            st = trv.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
            model = regressor(name, st["n"], float(st["s"] or 0.0), seed=seed, **kw).fit(trv)
            r = regression_metrics(model.transform(vec.where(F.col("is_test")))).first()
            first.append(_number(r["r2"]))
            second.append(_number(r["mae"]))
        else:
            trv = balanced_weights(trv, "label")
            model = classifier(name, trv.count(), seed=seed, **kw).fit(trv)
            te = with_probability(model.transform(vec.where(F.col("is_test"))))
            te = te.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))
            r = classification_metrics(te).first()
            first.append(_number(r["roc_auc"]))
            second.append(_number(r["f1"]))
    base.unpersist()
    a, b = np.array(first), np.array(second)
    if kind == "regression":
        return {"r2_mean": np.nanmean(a), "r2_std": np.nanstd(a), "r2_scores": first, "mae_mean": np.nanmean(b), "mae_std": np.nanstd(b)}
    return {"roc_auc_mean": np.nanmean(a), "roc_auc_std": np.nanstd(a), "roc_auc_scores": first,
            "f1_mean": np.nanmean(b), "f1_std": np.nanstd(b)}
