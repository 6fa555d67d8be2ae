"""Driver tables and their bindings to the analytics inputs.

``txn``       orders as a purchase log: o_custkey, o_orderdate, o_totalprice.
``purchases`` events filtered to purchases: user_id, ts, value (intraday).
Only the needed columns are selected, so the parquet scan prunes the rest
and pushes the event_type filter down.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Literal reference dates, one day after the last purchase of
# each log, so that Spark and the SQL oracle see the same input.
TXN_REFERENCE_DATE = "2001-08-02 00:00:00"
PURCHASES_REFERENCE_DATE = "2024-01-31 00:00:00"
# Label cut for the supervised models: features before, outcome after.
TXN_LABEL_CUT = "2001-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id BIGINT, date TIMESTAMP_NTZ, amount DOUBLE."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id BIGINT, date TIMESTAMP_NTZ, amount DOUBLE (intraday)."""
    return (table(spark, sf_dir, "events")
            .where(F.col("event_type") == "purchase")
            .select(F.col("user_id").alias("customer_id"),
                    F.col("ts").alias("date"),
                    F.col("value").alias("amount")))


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ region: customer_id, region, segment, acctbal.

    nation (25 rows) and region (5 rows) are fixed-size dimensions of the
    TPC-H schema, so they are broadcast.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    return (c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("r_name").alias("region"),
                    F.col("c_mktsegment").alias("mktsegment"),
                    F.col("c_acctbal").alias("acctbal")))
