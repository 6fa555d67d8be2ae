"""RFM: metrics from transactions, quintile scores, segments, summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp, literal_like, whole_days
from ..functions.scaling import nan_to_null, zscore
from ..functions.validation import require_columns
from ..storage import kept
from .order_stats import select_ranks

# Segment labels in rule order (must equal the reference's).
SEGMENTS = [
    "Champions",
    "Loyal Customers",
    "New Customers",
    "Potential Loyalists",
    "Promising",
    "At Risk",
    "Hibernating",
    "Lost",
    "Regular",
]


def rfm_from_transactions(txn: DataFrame, customer_col: str = "customer_id",
                          date_col: str = "transaction_date", amount_col: str = "amount",
                          reference_date=None) -> DataFrame:
    """Per customer: frequency = purchases, monetary = spend, recency = whole
    days from the last purchase to ``reference_date`` (default: now).

    One hash aggregation with map-side partial aggregation, so a customer
    holding a third of all rows is combined before the shuffle.
    """
    require_columns(txn, [customer_col, date_col, amount_col], "rfm_from_transactions")
    txn = nan_to_null(txn, [amount_col])
    ref = F.current_timestamp() if reference_date is None else literal_like(txn, date_col, reference_date)
    agg = (
        txn.where(F.col(customer_col).isNotNull())
        .groupBy(customer_col)
        .agg(F.max(as_timestamp(txn, date_col)).alias("__last"),
             F.count(F.lit(1)).alias("frequency"),
             F.coalesce(F.sum(amount_col), F.lit(0.0)).cast("double").alias("monetary"))
    )
    return agg.select(
        F.col(customer_col),
        F.col("frequency"),
        F.col("monetary"),
        whole_days(ref, F.col("__last")).alias("recency"),
    )


def rfm_scores(rfm: DataFrame, recency_col: str = "recency", frequency_col: str = "frequency",
               monetary_col: str = "monetary", id_col: str = "customer_id",
               method: str = "quantile") -> DataFrame:
    """R/F/M scores 1..5 by quintile of the rank and their sum RFM_score.

    Low recency scores 5; high frequency and monetary score 5. Ties are
    broken by ``id_col`` ascending, in its own type. A column with a missing
    value (null or NaN), or a frame of one row, scores 3 throughout (the
    reference's fallback). The frame is written once; only the four edge rows
    of a column are looked for (``order_stats``), no row is sorted or shuffled.
    """
    if method != "quantile":
        raise ValueError("only the 'quantile' method is supported")
    require_columns(rfm, [id_col, recency_col, frequency_col, monetary_col], "rfm_scores")
    cols = [recency_col, frequency_col, monetary_col]
    out = rfm = kept(nan_to_null(rfm, cols))

    def edge(i: int):
        """0-based rank of the last row of bin i, if no value is missing and there are two rows."""
        return lambda n, rows: (i * (n - 1)) // 5 if n == rows and n > 1 else None

    found = select_ranks(rfm, {(c, i): (None, c, edge(i)) for c in cols for i in range(1, 5)}, id_col)
    id_type = rfm.schema[id_col].dataType
    tie = F.col(id_col)
    for c, score, reverse in ((recency_col, "R_score", True),
                              (frequency_col, "F_score", False),
                              (monetary_col, "M_score", False)):
        if found[c, 1] is None:
            out = out.withColumn(score, F.lit(3))
            continue
        v = F.col(c).cast("double")
        b = F.lit(1)
        for i in range(1, 5):
            value, last = found[c, i]
            later = tie.isNotNull() if last is None else tie > F.lit(last).cast(id_type)
            b = b + F.when((v > F.lit(value)) | ((v == F.lit(value)) & later), 1).otherwise(0)
        out = out.withColumn(score, (F.lit(6) - b) if reverse else b)
    return out.withColumn("RFM_score", F.col("R_score") + F.col("F_score") + F.col("M_score"))


def segment_expr(r: Column, f: Column, m: Column) -> Column:
    """First-match rule cascade over the three scores."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), SEGMENTS[0])
        .when((r >= 4) & (f >= 3), SEGMENTS[1])
        .when((r >= 4) & (f <= 2), SEGMENTS[2])
        .when((r >= 3) & (f >= 3) & (m >= 3), SEGMENTS[3])
        .when((r >= 3) & (f <= 2), SEGMENTS[4])
        .when((r <= 2) & (f >= 3) & (m >= 3), SEGMENTS[5])
        .when((r <= 2) & (f >= 4), SEGMENTS[6])
        .when((r <= 2) & (f <= 2) & (m <= 2), SEGMENTS[7])
        .otherwise(SEGMENTS[8])
    )


def segment_customers(scores: DataFrame) -> DataFrame:
    require_columns(scores, ["R_score", "F_score", "M_score"], "segment_customers")
    return scores.withColumn("segment", segment_expr(F.col("R_score"), F.col("F_score"), F.col("M_score")))


def segment_summary(segments: DataFrame, recency_col: str = "recency",
                    frequency_col: str = "frequency", monetary_col: str = "monetary") -> DataFrame:
    """Mean and sample std of R/F/M and mean RFM_score per segment, rounded
    half-to-even to 2 places (A3)."""
    aggs = []
    for c in (recency_col, frequency_col, monetary_col):
        aggs += [F.bround(F.avg(c), 2).alias(f"{c}_mean"), F.bround(F.stddev_samp(c), 2).alias(f"{c}_std")]
    aggs.append(F.bround(F.avg("RFM_score"), 2).alias("RFM_score_mean"))
    return segments.groupBy("segment").agg(*aggs)


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Customers per segment, largest first (A4)."""
    return (segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("customers"), F.asc("segment")))


def rfm_zscores(rfm: DataFrame, id_col: str = "customer_id", recency_col: str = "recency",
                frequency_col: str = "frequency", monetary_col: str = "monetary") -> DataFrame:
    """Z-scored R/F/M with the sample standard deviation."""
    return zscore(rfm, [recency_col, frequency_col, monetary_col], ddof=1, keep=[id_col])
