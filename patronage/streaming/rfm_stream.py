"""Running RFM metrics over a stream of purchases (A1 on Structured
Streaming).

The batch operator is a grouped aggregation, so its streaming form is the
same aggregation kept in Spark's state store: per customer last purchase,
count and spend, emitted in ``update`` mode. Recency is derived at read time
against a reference date, as in the batch operator. The reference library has
no streaming; this only lets the same metric follow an appended log.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import literal_like, whole_days
from ..functions.scaling import nan_to_null


def purchase_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Purchase events from a folder of parquet files, read incrementally."""
    return (spark.readStream.schema(schema).parquet(path)
            .where(F.col("event_type") == "purchase")
            .select(F.col("user_id").alias("customer_id"), F.col("ts").alias("date"),
                    F.col("value").alias("amount")))


def running_rfm(stream: DataFrame) -> DataFrame:
    """Stateful per-customer aggregates (update mode)."""
    return (nan_to_null(stream, ["amount"]).where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.max("date").alias("last_purchase"), F.count(F.lit(1)).alias("frequency"),
                 F.coalesce(F.sum("amount"), F.lit(0.0)).alias("monetary")))


def with_recency(snapshot: DataFrame, reference_date: str) -> DataFrame:
    """Recency in whole days at ``reference_date`` for a snapshot of the state."""
    return snapshot.select("customer_id", "frequency", "monetary",
                           whole_days(literal_like(snapshot, "last_purchase", reference_date),
                                      F.col("last_purchase")).alias("recency"))


def start(stream: DataFrame, target: str, checkpoint: str, available_now: bool = False):
    """Follow the log: every micro-batch writes the customers it changed as
    Parquet under ``target/batch=<id>``; a repeated batch replaces its own
    folder, so restarts lose and double nothing. Both folders must be shared
    on a cluster."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    w = (running_rfm(stream).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of every customer from what ``start`` has written."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("customer_id").agg(F.max(F.struct("batch", "last_purchase", "frequency", "monetary")).alias("r"))
    return latest.select("customer_id", "r.last_purchase", "r.frequency", "r.monetary")
