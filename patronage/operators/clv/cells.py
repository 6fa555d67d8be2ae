"""Bootstrap weights of cells: customers with equal observations are drawn together.

A Poisson bootstrap gives every customer a Poisson(1) weight in each replicate.
The weights of the n customers of a cell add up to a Poisson(n) draw, so one
draw for each (cell, replicate) is enough, and no customer is exploded. The
draw inverts the distribution function at a uniform number from the md5 of
(cell, replicate, seed): the same in every run, under any partitioning and in
any engine. The probabilities of a count are summed over ``WIDE`` standard
deviations around it, which leaves out less than a double can show, so a cell
of a third of all customers costs about the square root of its size, once.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

WIDE = 12


@functools.lru_cache(maxsize=1024)
def poisson_cdf(n: int) -> tuple[int, np.ndarray]:
    """(lowest count, distribution function from there on) of Poisson(n)."""
    low = max(0, int(n - WIDE * n ** 0.5 - WIDE))
    k = np.arange(low, int(n + WIDE * n ** 0.5 + 40) + 1, dtype=float)
    logs = np.r_[0.0, np.cumsum(np.log(n) - np.log(k[1:]))]
    p = np.exp(logs - logs.max())
    return low, np.cumsum(p / p.sum())


def uniforms(key: str, n_replicates: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from the first 52 bits of md5("key:replicate:seed")."""
    return np.array([int(hashlib.md5(f"{key}:{b}:{seed}".encode()).hexdigest()[:13], 16) for b in range(n_replicates)]) / 2.0 ** 52


def cell_weights(cells: DataFrame, keys, n_replicates: int, seed: int = 42, count: str = "n") -> DataFrame:
    """The cells (keys, count) as keys and ``weights``, an array of one Poisson(count) draw a replicate."""
    def run(batches):
        for b in batches:
            out = []
            for key, n in zip(b["__key"], b["__n"]):
                low, cdf = poisson_cdf(int(n))
                at = np.searchsorted(cdf, uniforms(key, n_replicates, seed), side="right")
                out.append(low + np.minimum(at, len(cdf) - 1))
            yield b[list(keys)].assign(weights=out)

    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    schema = StructType([cells.schema[k] for k in keys] + [StructField("weights", ArrayType(LongType()))])
    return cells.select(*keys, text.alias("__key"), F.col(count).alias("__n")).mapInPandas(run, schema)


def summed(weighted: DataFrame, keys, n_replicates: int) -> DataFrame:
    """Weights of coarser cells: arrays added up element by element, combined before the shuffle."""
    return weighted.groupBy(*keys).agg(F.array(*[F.sum(F.col("weights")[i]) for i in range(n_replicates)]).alias("weights"))
