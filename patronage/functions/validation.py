"""Input checks (P9): one aggregate job per check, errors raised on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, cols, where: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}")


def count_violations(df: DataFrame, **predicates) -> dict:
    """Count rows matching each named predicate in a single pass."""
    if not predicates:
        return {}
    row = df.agg(*[F.sum(F.when(p, 1).otherwise(0)).alias(k) for k, p in predicates.items()]).first()
    return {k: int(row[k] or 0) for k in predicates}
