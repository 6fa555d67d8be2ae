"""Cross-validation of linear models from the moments of the folds.

One grouped aggregate gives each fold's row count, means and co-moments of
features and target; partial aggregation combines them before the shuffle of
one row a fold. The training part of a fold is the other folds merged (sums
of co-moments and of the spread of their means, no subtraction), its
coefficients solve the normal equations, and the fold's own moments give the
squared error of these coefficients on it. So all folds, for any number of
models, cost one scan, and no row is scored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import nan_to_null
from ..functions.validation import require_columns
from .features import folds


def fold_moments(df: DataFrame, features, target: str, fold: str = "fold") -> dict:
    """{fold: (rows, means, co-moment matrix / rows)} of the features followed by the target."""
    cols = [*features, target]
    typed = nan_to_null(df.select(fold, *[F.col(c).cast("double").alias(c) for c in cols]), cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = typed.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.concat(*[F.col(c).cast("string") for c in cols]).isNull(), 1)).alias("missing"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(cols[i], cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # one row a fold
    if any(r["missing"] for r in rows):
        raise ValueError("missing values in a feature or the target: fill them first (impute_median)")
    out = {}
    for r in rows:
        c = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"s{i}_{j}"]
        out[r[fold]] = (r["n"], np.array([r[f"m{i}"] for i in range(len(cols))], float), c)
    return out


def merged(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the rows of all parts together."""
    parts = list(parts)
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n


def coefficients(moments, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and weights; ``alpha`` penalises the weights of standard-scaled features, as a scaled ridge model does.

    A constant feature weighs nothing; of collinear ones the smallest weights are taken.
    """
    n, mean, c = moments
    sd = np.sqrt(np.diag(c)[:-1])
    scale = np.where(sd > 0, sd, 1.0)
    gram = c[:-1, :-1] / np.outer(scale, scale) + np.eye(len(sd)) * alpha / n
    w = np.linalg.lstsq(gram, c[:-1, -1] / scale, rcond=1e-12)[0] / scale
    return float(mean[-1] - w @ mean[:-1]), w


def scores(moments, intercept: float, w: np.ndarray) -> tuple[float, float]:
    """R2 and root mean squared error of a linear model on the rows of the moments; R2 is NaN for a constant target."""
    _, mean, c = moments
    bias = mean[-1] - intercept - w @ mean[:-1]
    mse = max(float(c[-1, -1] - 2 * w @ c[:-1, -1] + w @ c[:-1, :-1] @ w + bias * bias), 0.0)
    return (1 - mse / c[-1, -1] if c[-1, -1] > 0 else float("nan")), float(np.sqrt(mse))


def cross_validate_linear(df: DataFrame, features, target: str, id_col: str = "customer_id", cv: int = 5, seed: int = 42,
                          alpha: float = 0.0) -> DataFrame:
    """fold, n_train, n_test, r2, rmse of least squares (``alpha`` 0) or ridge, one row a fold.

    Folds are those of ``features.folds`` with seed + 1, as in ``cross_validate``. Missing values raise.
    """
    require_columns(df, [id_col, target, *features], "cross_validate_linear")
    parts = fold_moments(folds(df.select(id_col, target, *features), id_col, cv, seed + 1), features, target)
    rows = []
    for k in sorted(parts):
        others = [m for j, m in parts.items() if j != k]
        if others:
            train = merged(others)
            r2, rmse = scores(parts[k], *coefficients(train, alpha))
            rows.append((k, train[0], parts[k][0], None if np.isnan(r2) else float(r2), rmse))
    return df.sparkSession.createDataFrame(rows, "fold int, n_train long, n_test long, r2 double, rmse double")
