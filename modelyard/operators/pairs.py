"""Exact all-against-all work without emitting pairs.

Rows are cut into hash blocks of bounded size. Every row is sent to the cells of a block-by-block grid that need it,
and one cell is one cogrouped NumPy product: it returns a summary per row (a sum, the nearest k, a spanning forest),
so the shuffle carries rows x blocks and never rows x rows. Block keys are hashes of the row key: no hot cell exists.
"""

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Least and most rows of a block.
BLOCK_ROWS, LARGE_BLOCK_ROWS = 4000, 32_000


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """A sixth of the rows is a block, within these bounds: a row is copied once per block of the other side."""
    return max(1, ceil(rows / max(block_rows, min(LARGE_BLOCK_ROWS, ceil(rows / 6)))))


def grid(
    left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, summary: Callable, schema: str
) -> DataFrame:
    """Apply `summary(left_block, right_block) -> pandas` to every pair of blocks; both tables need a `key` column."""

    def cut(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(own_blocks)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        return df.withColumn(own, block).withColumn(other, copies)

    a = cut(left, "_i", left_blocks, "_j", right_blocks)
    # New column ids, for a table that meets itself.
    b = cut(right.toDF(*right.columns), "_j", right_blocks, "_i", left_blocks)
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(summary, schema)


def matrix(block: pd.DataFrame, column: str = "features") -> np.ndarray:
    if not len(block):
        return np.zeros((0, 0))
    return np.stack(block[column].to_numpy()).astype(float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks, by differences, in slices that stay small."""
    out = np.empty((len(a), len(b)))
    step = max(1, int(4_000_000 // max(1, b.size)))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def summed_distances(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row of `a` the distances summed over the runs of rows of `b` that begin at `starts`.

    Squares come from one product, and by differences where rounding could show: where they are small next to the rows themselves.
    """
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    own, sizes = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left, right = np.hstack([-2 * x, np.ones((len(x), 1))]), np.hstack([y, sizes[:, None]]).T.copy()
    out = np.empty((len(a), len(starts)))
    step = max(1, 1_000_000 // len(b))
    for start in range(0, len(a), step):
        end = start + step
        square = left[start:end] @ right
        square += own[start:end, None]
        row, column = np.nonzero(square <= 1e-4 * (own[start:end, None] + sizes.max()))
        for i in range(0, len(row), 100_000):
            r, c = row[i : i + 100_000], column[i : i + 100_000]
            gap = a[start + r] - b[c]
            square[r, c] = np.einsum("ik,ik->i", gap, gap)
        out[start:end] = np.add.reduceat(np.sqrt(square, out=square), starts, axis=1)
    return out
