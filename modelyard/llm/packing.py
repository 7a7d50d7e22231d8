"""Packing into length buckets with the least padding.

One aggregate gives the global histogram of lengths. Dynamic programming over it finds the bucket boundaries with the least
padding; in each bucket, batches take as many documents as the token budget allows at the bucket's boundary.

The histogram has a bounded number of cells: each length up to `exact_to` is one, and above it each doubling has 64. A cell keeps
its count, sum and largest length, and a boundary is the largest length of a cell. So the boundaries are the best of all
boundaries where cells are single lengths, and the best of those that end a cell above.

Documents of a bucket are put in a seeded order and numbered without gaps: equal ranges of the seeded key are numbered on
their own and shifted by the counts of the ranges before, so a bucket with a third of all rows is many tasks.

Defined results: a NULL length counts as 0. A document longer than the budget is a batch of its own. Ties in the seeded order
go by id, then length; rows that are equal in both are numbered in any order. Of equally good boundaries the one whose
earlier boundaries are shorter wins. An empty table gives an empty result.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from modelyard.llm.common import join_small, partitions, seeded, written

EXACT_TO = 4096
CELLS_PER_DOUBLING = 64


def length_cell(length: Column, exact_to: int = EXACT_TO) -> Column:
    """The cell of a length: itself, or its place among the 64 equal parts of its doubling."""
    step = F.pow(F.lit(2.0), F.length(F.bin(length)) - CELLS_PER_DOUBLING.bit_length()).cast("long")
    return F.when(length <= exact_to, length).otherwise(length - F.pmod(length, step))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (largest lengths, ascending) of at most `buckets` buckets with the least padding.

    `lengths` are the largest lengths of the cells in order, `counts` and `sums` their documents and tokens.
    """
    cells = len(lengths)
    if not cells:
        return []
    ahead = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)
    lengths = np.asarray(lengths, np.int64)
    # cost[j]: least padding of the first j cells; row by row one bucket more.
    never = np.iinfo(np.int64).max // 4
    cost = np.full(cells + 1, never)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, cells)):
        fresh, chosen = np.full(cells + 1, never), np.zeros(cells + 1, np.int64)
        for j in range(1, cells + 1):
            padded = cost[:j] + lengths[j - 1] * (ahead[j] - ahead[:j]) - (tokens[j] - tokens[:j])
            chosen[j] = np.argmin(padded)
            fresh[j] = padded[chosen[j]]
        back.append(chosen)
        cost = fresh
    ends, j = [], cells
    for chosen in reversed(back):
        ends.append(int(lengths[j - 1]))
        j = int(chosen[j])
    return sorted(ends)


def histogram(lengths: DataFrame, length: str = "n_tokens") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest length, documents and tokens of each cell; at most a few thousand cells for any table."""
    rows = (
        lengths.groupBy(length_cell(F.col(length)).alias("cell"))
        .agg(F.max(length).alias("top"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"))
        .orderBy("cell")
        .collect()
    )
    return tuple(np.array([r[c] for r in rows], np.int64) for c in ("top", "rows", "tokens"))


def pack(
    docs: DataFrame, length: Column, identity: str = "doc_id", buckets: int = 16, budget: int = 65_536, seed: int = 11
) -> DataFrame:
    """One row per document: `doc_id`, `n_tokens`, `bucket`, `boundary`, `batch` (from 0 within the bucket), `padding`."""
    spark = docs.sparkSession
    lengths = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    # Texts are read once; what follows works on two numbers per document.
    rows = written(lengths, "lengths")
    tops, counts, sums = histogram(rows)
    ends = best_boundaries(tops, counts, sums, buckets) or [0]
    above = [(F.col("n_tokens") > F.lit(e)).cast("long") for e in ends]
    rows = rows.withColumn("bucket", sum(above[1:], above[0]))
    rows = rows.withColumn("boundary", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket").cast("int") + 1))
    pieces = max(partitions(spark), int(counts.sum()) // 50_000 + 1)
    rows = rows.withColumn("_key", seeded(seed, F.col("doc_id")))
    rows = rows.withColumn("_piece", F.floor(F.col("_key") / F.lit(float(1 << 52)) * pieces))
    totals = rows.groupBy("bucket", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("bucket", "_piece").orderBy("_key", "doc_id", "n_tokens")
    numbered = rows.withColumn("_row", F.row_number().over(inner) - 1)
    numbered = join_small(numbered, totals, ["bucket", "_piece"], "inner")
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "boundary",
        F.floor((F.col("_row") + F.col("_before")) / capacity).alias("batch"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
