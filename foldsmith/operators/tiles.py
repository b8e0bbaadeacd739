"""Exact similarity joins in tiles.

Both sides are dealt to blocks by a hash of their id, and every pair of blocks is a task of its own with a matrix kernel. A row goes
to as many tasks as the other side has blocks, so there are no more than MOST_BLOCKS of them, whatever the number of rows, until a
block would hold more than LARGEST rows: what is shuffled grows with the rows, not with their square. A task holds two blocks and
returns only what passes; the work is spread evenly whatever the data look like. Self-joins do each unordered pair of blocks once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block where there are few, blocks of a side where there are more, and rows of a block at most.
BLOCK, MOST_BLOCKS, LARGEST = 1024, 16, 32_768
#: Products that a kernel holds at once.
PRODUCTS = 1 << 22


def matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of equally long list cells as a matrix."""
    col = column.combine_chunks()
    if not len(col):
        return np.empty((0, 1), kind)
    return np.asarray(col.flatten()).astype(kind, copy=False).reshape(len(col), -1)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks())


def blocks_of(df: DataFrame, block: int) -> int:
    return blocks_for(df.count(), block)


def blocks_for(rows: int, block: int = BLOCK) -> int:
    return max(1, min(-(-rows // block), MOST_BLOCKS), -(-rows // LARGEST))


def slices(rows: int, columns: int) -> list[slice]:
    """Slices of the rows that have no more than PRODUCTS products with the columns, and one row at least."""
    step = max(1, PRODUCTS // max(1, columns))
    return [slice(at, at + step) for at in range(0, rows, step)]


def tile_join(left: DataFrame, right: DataFrame, key: str, kernel: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, block: int = BLOCK) -> DataFrame:
    """Union of kernel(left block, right block) over all pairs of blocks."""
    nl, nr = blocks_of(left, block), blocks_of(right, block)
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_l", own(nl)).withColumn("_r", every(nr))
    b = right.withColumn("_r", own(nr)).withColumn("_l", every(nl))
    return _apply(a, b, kernel, ddl)


def tile_self_join(df: DataFrame, key: str, kernel: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, block: int = BLOCK) -> DataFrame:
    """As tile_join of df with itself, each unordered pair of rows in one task; the kernel gets two blocks, maybe the same one twice."""
    n = blocks_of(df, block)
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    a = df.withColumn("_l", own).withColumn("_r", F.explode(F.sequence(F.col("_l"), F.lit(n - 1))))
    b = df.withColumn("_r", own).withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_r"))))
    return _apply(a, b, kernel, ddl)


def _apply(a, b, kernel, ddl):
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return kernel(x, y)

    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # a self-join's sides need columns of their own
    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInArrow(run, ddl)


def once(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of places i of a and j of b are of different ids and, if met in both orders, the one to take."""
    same_block = np.isin(a[i], b) & np.isin(b[j], a)
    return (a[i] != b[j]) & (~same_block | (a[i] < b[j]))
