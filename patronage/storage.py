"""Frames written once to the shared checkpoint folder and read back."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


def _place(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, whose files go when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared checkpoint folder: later passes read columns
    of it and not its lineage, and a lost executor costs no recomputation. The
    files go when the driver ends."""
    spark = df.sparkSession
    path = _place(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _passing:
        _passing[-1].append(out)
    return out


#: Frames kept inside the ``passing`` blocks that are open.
_passing: list[list[DataFrame]] = []


def discard(*frames: DataFrame) -> None:
    """Delete the files of kept frames that nothing will read again."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Frames kept inside are deleted at the end, but those put into the list it gives."""
    made, stay = [], []
    _passing.append(made)
    try:
        yield stay
    finally:
        _passing.pop()
        left = {df._kept_at for df in stay}
        discard(*[df for df in made if df._kept_at not in left])


def kept_csv(df: DataFrame) -> str:
    """Path of the frame as CSV files with a header row, in the same folder."""
    path = _place(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path
