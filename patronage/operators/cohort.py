"""Cohort retention and revenue.

Plan: pre-aggregate to one row per (customer, period) with map-side partial
aggregation (a customer with a third of all rows collapses to at most one row
per period before any shuffle), take the first period per customer with a
window over that bounded set, then one aggregation per (cohort, offset). The
cohort x offset grid is the output matrix itself (bounded by the number of
periods, not by the data) and is built by exploding offsets per cohort.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp, check_period, period_diff, period_start
from ..functions.scaling import nan_to_null
from ..functions.validation import require_columns


def cohort_report(txn: DataFrame, customer_col: str = "customer_id", date_col: str = "date",
                  value_col: str = "amount", period: str = "M") -> DataFrame:
    """Long cohort report: cohort, period_offset, cohort_size, active,
    revenue, retention = active / size, arpu = revenue / size.

    Cohort = period of the first purchase; every cohort carries every offset
    seen anywhere, with 0 where the cohort had no activity (the reference's
    filled matrix).
    """
    check_period(period)
    require_columns(txn, [customer_col, date_col, value_col], "cohort_report")
    txn = nan_to_null(txn, [value_col])
    per = (
        txn.where(F.col(customer_col).isNotNull())
        .groupBy(F.col(customer_col).alias("__cust"),
                 period_start(as_timestamp(txn, date_col), period).alias("__period"))
        .agg(F.sum(value_col).alias("__rev"))
    )
    per = (per.withColumn("cohort", F.min("__period").over(Window.partitionBy("__cust")))
           .withColumn("period_offset", period_diff(F.col("__period"), F.col("cohort"), period)))
    cells = per.groupBy("cohort", "period_offset").agg(
        F.count(F.lit(1)).alias("active"),
        F.coalesce(F.sum("__rev"), F.lit(0.0)).cast("double").alias("revenue"),
    ).persist()
    sizes = cells.where(F.col("period_offset") == 0).select("cohort", F.col("active").alias("cohort_size"))
    max_offset = cells.agg(F.max("period_offset")).first()[0]
    if max_offset is None:
        return cells.select("cohort", "period_offset").withColumn("cohort_size", F.lit(0).cast("long")) \
            .withColumn("active", F.lit(0).cast("long")).withColumn("revenue", F.lit(0.0)) \
            .withColumn("retention", F.lit(0.0)).withColumn("arpu", F.lit(0.0))
    seen = cells.select("period_offset").distinct()
    grid = (sizes.withColumn("period_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(max_offset)).cast("long"))))
            .join(F.broadcast(seen), "period_offset", "left_semi"))
    out = grid.join(cells, ["cohort", "period_offset"], "left")
    active = F.coalesce(F.col("active"), F.lit(0).cast("long"))
    revenue = F.coalesce(F.col("revenue"), F.lit(0.0))
    return out.select(
        "cohort", "period_offset", "cohort_size",
        active.alias("active"), revenue.alias("revenue"),
        (active / F.col("cohort_size")).alias("retention"),
        (revenue / F.col("cohort_size")).alias("arpu"),
    )


def cohort_sizes(report: DataFrame) -> DataFrame:
    return report.select("cohort", "cohort_size").distinct()


def retention_curves(report: DataFrame, max_offset: int = 12) -> DataFrame:
    """Long retention cells up to ``max_offset``."""
    return report.where(F.col("period_offset") <= max_offset)


def wide(report: DataFrame, value: str = "retention", max_offset: int = 12, prefix: str = "o") -> DataFrame:
    """cohort x offset matrix (U1) with an explicit pivot value list, so no
    extra job discovers the pivot values; columns ``o0``..``o{max_offset}``."""
    values = list(range(max_offset + 1))
    piv = (retention_curves(report, max_offset).groupBy("cohort")
           .pivot("period_offset", values).agg(F.first(value)))
    return piv.select("cohort", *[F.coalesce(F.col(str(v)), F.lit(0.0)).alias(f"{prefix}{v}") for v in values])


def average_retention(report: DataFrame, max_offset: int = 12) -> DataFrame:
    """Mean retention per offset over cohorts with non-zero retention, 0 if
    none (C3). Real zeros are skipped as well, as in the reference."""
    return (retention_curves(report, max_offset).groupBy("period_offset")
            .agg(F.coalesce(F.avg(F.when(F.col("retention") != 0, F.col("retention"))), F.lit(0.0))
                 .alias("avg_retention")))
