"""Scaling and imputation as Column expressions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, cols) -> DataFrame:
    """NaN counts as missing: null in the float and double columns among ``cols``."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) for c in cols
                           if kinds.get(c) in ("double", "float")})


def column_stats(df: DataFrame, cols, ddof: int = 1) -> DataFrame:
    """One-row frame of mean and standard deviation for each column."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), std(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (an aggregate without keys) to
    every row of ``df``: one broadcast row, one output row per row of ``df``.
    """
    return df.crossJoin(F.broadcast(one_row))


def zscore(df: DataFrame, cols, ddof: int = 1, keep=()) -> DataFrame:
    """(x - mean) / std per column; the one-row statistics are broadcast.

    ddof=1 is the sample deviation used for RFM features, ddof=0 the
    population deviation of a standard scaler. A constant column (std 0)
    is divided by 1, as scalers do.
    """
    df = nan_to_null(df, cols)
    stats = column_stats(df, cols, ddof)
    joined = attach_row(df, stats)
    out = [F.col(k) for k in keep]
    for c in cols:
        sd = F.col(f"{c}__std")
        sd = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        out.append(((F.col(c) - F.col(f"{c}__mean")) / sd).alias(c))
    return joined.select(*out)
