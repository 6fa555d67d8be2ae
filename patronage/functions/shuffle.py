"""Keyed permutations of the positions 0 .. n - 1, without a sort.

A position is written as two digits (left, right) to the bases a = ceil(sqrt(n))
and b = ceil(n / a); four rounds add a keyed hash of one digit to the other, which
can be undone, so distinct positions stay distinct. Results of n or more (fewer
than a of the a * b) go through the rounds again until they are below n. Integer
arithmetic only, so SQL gives the same numbers.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, FACTOR, ROUNDS = 2_147_483_647, 48_271, 4
KEY_SEED, KEY_GROUP, KEY_ROUND = 1_000_003, 7_919, 104_729


def _hash(digit: np.ndarray, key: int) -> np.ndarray:
    t = (digit + key) % PRIME
    t = (t * t + key) % PRIME
    return t * FACTOR % PRIME


def permuted(positions: np.ndarray, n: int, group: int, seed: int = 0) -> np.ndarray:
    """Where permutation ``group`` of 0 .. n - 1 sends the positions."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = [(seed * KEY_SEED + group * KEY_GROUP + r * KEY_ROUND + 1) % PRIME * FACTOR % PRIME for r in range(ROUNDS)]
    x = np.array(positions, dtype=np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] // b, x[todo] % b
        for r, key in enumerate(keys):
            if r % 2:
                right = (right + _hash(left, key)) % b
            else:
                left = (left + _hash(right, key)) % a
        x[todo] = left * b + right
        todo = todo[x[todo] >= n]
    return x


def targets(position: str, n: int, groups: int, seed: int = 0) -> Column:
    """Array of where each of ``groups`` permutations sends a position."""
    if seed < 0:
        raise ValueError("seed must not be negative")

    @F.pandas_udf("array<long>")
    def send(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            x = p.to_numpy(np.int64)
            yield pd.Series(list(np.column_stack([permuted(x, n, g, seed) for g in range(groups)])), dtype=object)
    return send(position)
