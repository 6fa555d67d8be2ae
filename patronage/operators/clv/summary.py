"""CLV input table (V1/A2): one row per customer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.dates import as_timestamp, literal_like, whole_days
from ...functions.scaling import attach_row, nan_to_null
from ...functions.validation import require_columns


def clv_summary(txn: DataFrame, customer_col: str = "customer_id", date_col: str = "date",
                value_col: str = "amount", observation_end=None) -> DataFrame:
    """first_purchase, last_purchase, frequency = purchases - 1 (repeat
    purchases), T = whole days first -> end, recency = whole days first ->
    last, monetary_value = mean amount over all purchases (0 when frequency
    is 0). ``observation_end`` defaults to the last purchase in the log (one
    scalar aggregate). A single grouped aggregation with map-side combine.
    """
    require_columns(txn, [customer_col, date_col, value_col], "clv_summary")
    txn = nan_to_null(txn, [value_col])
    ts = as_timestamp(txn, date_col)
    agg = (txn.where(F.col(customer_col).isNotNull())
           .groupBy(customer_col)
           .agg(F.min(ts).alias("first_purchase"), F.max(ts).alias("last_purchase"),
                F.count(F.lit(1)).alias("__n"), F.avg(value_col).alias("__mean")))
    if observation_end is None:
        # one-row scalar aggregate attached by a broadcast equi-join; the
        # value never leaves the cluster
        agg = attach_row(agg, txn.agg(F.max(ts).alias("__end")))
    else:
        agg = agg.withColumn("__end", literal_like(txn, date_col, observation_end))
    end_col = F.col("__end")
    freq = (F.col("__n") - 1).cast("long")
    return agg.select(
        customer_col, "first_purchase", "last_purchase",
        freq.alias("frequency"),
        whole_days(end_col, F.col("first_purchase")).alias("T"),
        whole_days(F.col("last_purchase"), F.col("first_purchase")).alias("recency"),
        F.when(freq == 0, F.lit(0.0)).otherwise(F.col("__mean")).cast("double").alias("monetary_value"),
    )
