"""Page-level numbers (K9, A14-A20, F6) as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import attach_row, nan_to_null
from .order_stats import quantiles


def heuristic_ltv(monetary="monetary", frequency="frequency", recency="recency"):
    """monetary * frequency * (12 / (recency / 30 + 1)) when no label exists."""
    return F.col(monetary) * F.col(frequency) * (12.0 / (F.col(recency) / 30.0 + 1.0))


def overview(df: DataFrame) -> DataFrame:
    """Customer count, mean ltv, churn rate in %, mean monetary; NULL for a
    missing column (A15)."""
    return df.agg(F.count(F.lit(1)).alias("customers"),
                  F.avg("ltv").alias("avg_ltv") if "ltv" in df.columns else F.lit(None).cast("double").alias("avg_ltv"),
                  (F.avg(F.col("churn").cast("double")) * 100).alias("churn_rate_pct") if "churn" in df.columns
                  else F.lit(None).cast("double").alias("churn_rate_pct"),
                  F.avg("monetary").alias("avg_monetary") if "monetary" in df.columns
                  else F.lit(None).cast("double").alias("avg_monetary"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column's min and max (A17): bin index,
    lower and upper edge, count. The top edge falls into the last bin."""
    mm = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    j = attach_row(df.select(col).where(F.col(col).isNotNull()), mm)
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(
        F.least(F.floor((F.col(col) - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    return (j.groupBy(b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("lower"),
                    (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("upper"),
                    "count"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """mean, median, population std, min, max, q25, q75, q90 with linear
    interpolation (A14); the quantiles are exact and found by counting passes."""
    df = nan_to_null(df.select(F.col(col).cast("double").alias(col)), [col])
    q = quantiles(df, [col], [0.25, 0.5, 0.75, 0.9])[col]
    lit = [F.lit(x).cast("double") for x in q]
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"),
                  F.max(col).alias("max")).select(
        "mean", lit[1].alias("median"), "std", "min", "max", lit[0].alias("q25"), lit[2].alias("q75"), lit[3].alias("q90"))


def segment_share(segments: DataFrame, value: str = "monetary") -> DataFrame:
    """Segment size, mean value and share of customers in %."""
    g = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("avg_value"))
    tot = segments.agg(F.count(F.lit(1)).alias("__n"))
    return attach_row(g, tot).select("segment", "size", "avg_value",
                                     (F.col("size") / F.col("__n") * 100).alias("share_pct"))


def score_means(scores: DataFrame) -> DataFrame:
    """Mean R, F and M scores."""
    return scores.agg(F.avg("R_score").alias("avg_R"), F.avg("F_score").alias("avg_F"), F.avg("M_score").alias("avg_M"))


def high_risk_summary(scored: DataFrame, prob: str = "churn_probability", threshold: float = 0.7) -> DataFrame:
    """Count and share of customers at or above the risk threshold."""
    return scored.agg(F.sum(F.when(F.col(prob) >= threshold, 1).otherwise(0)).alias("high_risk"),
                      (F.avg(F.when(F.col(prob) >= threshold, 1.0).otherwise(0.0)) * 100).alias("high_risk_pct"))


def segment_profile_norm(segments: DataFrame, cols=("recency", "frequency", "monetary")) -> DataFrame:
    """Mean profile per segment, min-max normalised across segments with
    +1e-10 (A6)."""
    prof = segments.groupBy("segment").agg(*[F.avg(c).alias(c) for c in cols])
    mm = prof.agg(*[F.min(c).alias(f"{c}__lo") for c in cols], *[F.max(c).alias(f"{c}__hi") for c in cols])
    j = attach_row(prof, mm)
    return j.select("segment", *[((F.col(c) - F.col(f"{c}__lo")) / (F.col(f"{c}__hi") - F.col(f"{c}__lo") + 1e-10)).alias(c)
                                 for c in cols])
