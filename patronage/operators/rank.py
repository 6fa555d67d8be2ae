"""Exact global rank without a single-task window.

``row_number().over(Window.orderBy(...))`` with no partition moves every row
into one task. Instead the frame is range-partitioned and sorted by the full
order key (value plus a unique tie-break id, so heavy ties still spread over
partitions), each row is tagged with its partition and position, and the
result is checkpointed so that both following jobs see the same layout. The
per-partition counts (one row per partition, never per data row) give the
offsets; rank = offset + position + 1.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def global_rank(df: DataFrame, order_cols, name: str = "rn") -> DataFrame:
    """Add a 1-based dense position ``name`` following ``order_cols`` ascending.

    ``order_cols`` must form a unique key (end it with an id column).
    """
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (
        df.orderBy(*order_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), _POS_BITS))
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    # at most one row per partition: a tiny window over the partition counts
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__off") + F.col("__pos") + 1)
        .drop("__pid", "__pos", "__off")
    )


def prefix_sums(df: DataFrame, order_cols, value_cols, group_cols=(), inclusive: bool = False,
                suffix: str = "_before") -> DataFrame:
    """Running sums of ``value_cols`` along ``order_cols`` within each group,
    without gathering a group into one task.

    The frame is range-sorted by (group, order) and checkpointed; sums run
    inside each (partition, group) slice, and the totals of the earlier
    slices of the same group (a table of at most partitions x groups rows)
    are added as offsets. ``order_cols`` must make the order unique within a
    group. ``inclusive`` includes the current row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    groups = [F.col(g) for g in group_cols]
    tagged = (df.orderBy(*groups, *order_cols).withColumn("__pid", F.spark_partition_id())
              .checkpoint(eager=True))
    totals = tagged.groupBy("__pid", *group_cols).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *group_cols, *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}")
                                                    for v in value_cols])
    end = 0 if inclusive else -1
    w_in = Window.partitionBy("__pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    local = tagged.select("*", *[F.coalesce(F.sum(v).over(w_in), F.lit(0)).alias(f"__l_{v}") for v in value_cols])
    out = local.join(F.broadcast(offsets), ["__pid", *group_cols])
    return out.select(*df.columns, *[(F.col(f"__l_{v}") + F.col(f"__o_{v}")).alias(f"{v}{suffix}") for v in value_cols])
