"""A shuffle without a sort: a keyed bijection between row numbers and places.

Numbers 0..n-1 are pairs (left, right) of a grid of about square shape. A round
adds to one half a keyed function of the other, which can be undone, so rounds
in a row are a bijection of the grid; numbers that leave 0..n-1 walk on through
it until they are back. The grid has less than one row more than n numbers, so
hardly any walk is longer than one step. No row meets another: the place of a
row needs no exchange, and the inverse names the row of any place.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
# A prime below 2**31: products of two remainders fit a signed 64-bit number.
PRIME = (1 << 31) - 1
# Numbers that the grid's halves, and so their products, can hold.
MOST = 1 << 60


def round_keys(seed: int) -> list[tuple[int, int]]:
    """An added and a factor per round, from the MD5 of seed and round."""
    keys = []
    for i in range(ROUNDS):
        hexed = hashlib.md5(f"{seed}:{i}".encode(), usedforsecurity=False).hexdigest()
        keys.append((int(hexed[:8], 16) % PRIME, 1 + int(hexed[8:16], 16) % (PRIME - 1)))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sizes of the halves: the left one the rounded up root, the right one as many as needed."""
    left = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return left, max(-(-n // left), 1)


def _mixed(x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    y = (x + key[0]) % PRIME
    return y * y % PRIME * key[1] % PRIME


def _once(x: np.ndarray, sizes: tuple[int, int], keys: list[tuple[int, int]], back: bool) -> np.ndarray:
    left, right = x // sizes[1], x % sizes[1]
    sign = -1 if back else 1
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            left = (left + sign * _mixed(right, keys[i])) % sizes[0]
        else:
            right = (right + sign * _mixed(left, keys[i])) % sizes[1]
    return left * sizes[1] + right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of numbers in 0..n-1, or with ``back`` the numbers at places."""
    if n > MOST:
        raise ValueError(f"More than {MOST} rows")
    sizes, keys = grid(n), round_keys(seed)
    out = _once(x, sizes, keys, back)
    while len(walking := np.flatnonzero(out >= n)):
        out[walking] = _once(out[walking], sizes, keys, back)
    return out


def _column(c: Column, n: Column, seed: int, back: bool) -> Column:
    @F.pandas_udf(T.LongType())
    def places(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(np.int64), int(n.iloc[0]), seed, back) if len(x) else x)

    outside = F.raise_error(F.lit("A row number lies outside of 0..n-1")).cast("bigint")
    number = c.cast("bigint")
    return places(F.when((number >= 0) & (number < n), number).otherwise(outside), n)


def shuffled_place(number: Column, n: Column | int, seed: int) -> Column:
    """The place of row ``number`` of ``n`` in the order of ``seed``."""
    return _column(number, F.lit(n).cast("bigint") if isinstance(n, int) else n, seed, False)


def row_at_place(place: Column, n: Column | int, seed: int) -> Column:
    """The number of the row at a place: the inverse of shuffled_place."""
    return _column(place, F.lit(n).cast("bigint") if isinstance(n, int) else n, seed, True)


def shuffled_batches(
    df: DataFrame, batch_size: int, seed: int, number: str = "row_idx", n: int | None = None
) -> DataFrame:
    """Adds batch_id and batch_pos of a shuffled order to rows that are numbered 0..n-1.

    Rows are neither sorted nor moved; ``n`` is counted by a scalar subquery
    where it is not given. A number that is null or outside is an error;
    corpora with gaps are numbered first (``with_dense_index``).
    """
    if batch_size < 1:
        raise ValueError("A batch has at least one row")
    total = F.lit(n).cast("bigint") if n is not None else df.agg(F.count(F.lit(1))).scalar()
    counted = df.withColumn("__n", total)
    placed = counted.withColumn("__place", _column(F.col(number), F.col("__n"), seed, False))
    return placed.select(
        *df.columns,
        F.floor(F.col("__place") / batch_size).alias("batch_id"),
        (F.col("__place") % batch_size).cast("int").alias("batch_pos"),
    )


def batch_rows(batch_id: Column, batch_pos: Column, batch_size: int, n: Column | int, seed: int) -> Column:
    """The number of the row in a slot of a batch, without looking at any other row."""
    return row_at_place(batch_id * batch_size + batch_pos, n, seed)
