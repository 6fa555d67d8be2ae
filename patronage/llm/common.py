"""Helpers shared by the corpus operators.

Words are runs of characters other than U+0020 and U+0009-U+000D, which is
what ``bytes.split()`` cuts an UTF-8 text into.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Entries a per-task word cache may hold before it starts anew.
CACHE_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Frames written as Parquet to the shared checkpoint folder and read back.

    That cuts the lineage as ``checkpoint()`` does, and a lost executor costs
    no recomputation; unlike a checkpointed plan, the new one carries no
    inherited constraints, which grow from round to round of an iteration.
    What ``clear`` has not deleted goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n, self.tables = spark, 0, []
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/patronage-{uuid.uuid4().hex}"
        self._files().deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(self.path))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Write a frame as a table in buckets of ``key``: joins on the key read it without a shuffle."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"patronage_{uuid.uuid4().hex}"
        df.write.bucketBy(parts, key).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        """Delete the files, once all that depends on them is written."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


def written(df: DataFrame) -> DataFrame:
    """A frame kept in the checkpoint folder for as long as the caller needs it."""
    return Scratch(df.sparkSession).keep(df)


def column_udf(factory: Callable[[], Callable], returns: DataType | str):
    """Arrow UDF of one column; ``factory()`` runs once a task and makes the row function.

    For a struct type the row function returns a tuple in field order.
    """
    def rows():
        f = factory()
        return lambda values: [f(x) for x in values]
    return batch_udf(rows, returns)


def batch_udf(factory: Callable[[], Callable], returns: DataType | str):
    """Like ``column_udf``, with a function from the values of an Arrow batch to their results."""
    struct = [f.name for f in returns.fields] if isinstance(returns, StructType) else None

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory()
        for s in batches:
            yield pd.Series(f(s), dtype=object)

    @F.pandas_udf(returns)
    def apply_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = factory()
        for s in batches:
            rows = f(s)
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(struct)})

    return apply_struct if struct else apply


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one shingle."""
    h = hash_words(lower_words(text))
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * _MIX + h[i:i + n])
    return np.unique(out)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), for every linked id.

    Each round points every vertex at its smallest neighbour, shortens those
    pointers by doubling and contracts the links, so only links between
    different groups remain. Each step is a grouped minimum (combined before
    its shuffle) or an equi-join that adaptive execution may split; the
    smallest id of a component always points at itself and is what remains.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    saved = scratch.keep
    left = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .where("a < b").distinct())
    labels = None
    while not left.isEmpty():
        up = both(left).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")) \
            .select("id", F.least("id", "p").alias("p"))
        up = saved(up.join(up.select(F.col("id").alias("p"), F.col("p").alias("q")), "p", "left")
                   .select("id", F.coalesce("q", "p").alias("p")))
        low = up.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        high = up.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        left = saved(left.join(low, "a").join(high, "b")
                     .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                     .where("a < b").distinct())
        if labels is None:
            labels = up.withColumnRenamed("p", "component")
        else:
            moved = labels.alias("x").join(
                up.select(F.col("id").alias("component"), F.col("p").alias("q")), "component", "left") \
                .select("id", F.coalesce("q", "component").alias("component"))
            labels = saved(moved)
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
