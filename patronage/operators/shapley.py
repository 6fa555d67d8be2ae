"""Exact Shapley values of any score over all coalitions of features.

A coalition takes its features from the row and the others from the
background, averaged over the background rows; the value of a feature is the
weighted sum of what it adds to each of the 2^(d-1) coalitions without it. In
matrix form the values of a row are its 2^d coalition scores times one fixed
matrix, so a task scores slices of rows as one numpy array: no row is exploded
in Spark, nothing is shuffled, and every row gets all its values.

Up to ``MAX_FEATURES`` features; beyond that ``explain``'s sampled form is
the one to take. The background is an array of at most ``MAX_BACKGROUND`` rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.validation import require_columns

MAX_FEATURES, MAX_BACKGROUND = 12, 1000
#: Scored feature rows held at once in a task.
CELLS = 1 << 18


def coalition_weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which features are in each of 2^d coalitions, matrix from their scores to the d values)."""
    inside = (np.arange(2 ** d)[:, None] >> np.arange(d)) & 1 == 1
    size = inside.sum(axis=1)
    w = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
    return inside, np.where(inside, w[np.maximum(size - 1, 0)][:, None], -w[np.minimum(size, d - 1)][:, None])


def shapley_values(x: np.ndarray, background: np.ndarray, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Values [rows, d] of rows x against the background rows."""
    n, d = x.shape
    inside, matrix = coalition_weights(d)
    step = max(1, CELLS // (len(inside) * len(background)))
    out = np.empty((n, d))
    for lo in range(0, n, step):
        part = x[lo:lo + step]
        mixed = np.where(inside[None, :, None, :], part[:, None, None, :], background[None, None, :, :])
        v = np.asarray(score(mixed.reshape(-1, d)), float).reshape(len(part), len(inside), len(background)).mean(axis=2)
        out[lo:lo + step] = v @ matrix
    return out


def exact_shapley(df: DataFrame, features, score: Callable[[np.ndarray], np.ndarray], background,
                  id_col: str = "customer_id") -> DataFrame:
    """(id, shap_<feature> ...) of every row; ``score`` maps a numpy array [rows, d] to [rows].

    The values of a row add up to its score less the mean score of the
    background. A row with a missing feature (null or NaN) has null values.
    """
    features = list(features)
    require_columns(df, [id_col, *features], "exact_shapley")
    base = np.asarray(background, float).reshape(-1, len(features))
    if not 1 <= len(features) <= MAX_FEATURES:
        raise ValueError(f"exact values take 1 to {MAX_FEATURES} features")
    if not 1 <= len(base) <= MAX_BACKGROUND:
        raise ValueError(f"the background has 1 to {MAX_BACKGROUND} rows")

    def run(batches):
        for b in batches:
            x = b[features].to_numpy(float)
            full = ~np.isnan(x).any(axis=1)
            values = np.full(x.shape, np.nan)
            if full.any():
                values[full] = shapley_values(x[full], base, score)
            out = pd.DataFrame({f"shap_{f}": pd.Series(values[:, i], index=b.index).where(full, None) for i, f in enumerate(features)})
            yield out.assign(**{id_col: b[id_col]})[[id_col, *out.columns]]

    schema = StructType([df.schema[id_col]] + [StructField(f"shap_{f}", DoubleType()) for f in features])
    return df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(run, schema)
