"""Exact nearest neighbours: classification, regression and the neighbour table."""

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import as_array
from modelyard.operators import metric_index
from modelyard.operators.metric_index import BLOCK_ROWS, CELL_ROWS, Index, Rings, stacked
from modelyard.session import cut_lineage


def nearest(
    queries: DataFrame, donors: DataFrame, k: int, skip_self: bool = False, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(key, donor, gap, label) of the k nearest donors of every query row; ties by donor key.

    Both tables have `key` and `features`, the donors `label` too. A row first meets the rings that surely hold k donors near it; the gap of
    the k-th of those then rules out every ring that is farther away, and the row meets what is left.
    """
    left = cut_lineage(queries.select("key", as_array(queries, "features").alias("features")))
    right = donors.select("key", as_array(donors, "features").alias("features"), F.col("label").cast("double").alias("label"))
    index = metric_index.build(right, cell_rows, block_rows)
    wanted = k + skip_self
    if not len(index.rings):
        donor = F.lit(None).cast(donors.schema["key"].dataType)
        return left.limit(0).select("key", donor.alias("donor"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("label"))
    rings: Rings = index.rings
    summary, schema = _best_of_tile(left, right, k, skip_self)

    def near(visitors: DataFrame, wants) -> DataFrame:
        found = metric_index.tiles(visitors, index, wants, summary, schema, block_rows)
        return cut_lineage(metric_index.best(found, ["key"], ["gap", "donor"], k))

    left = left.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    first = near(left.withColumn("reach", F.lit(float("inf"))), lambda x, _: rings.home(x, wanted))
    reach = first.groupBy("key").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n"))
    reach = reach.select("key", F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(float("inf"))).alias("reach"))
    later = left.join(reach, "key", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    second = near(later, _later(rings, wanted))
    return metric_index.best(first.unionByName(second), ["key"], ["gap", "donor"], k).select("key", "donor", "gap", "label")


def first_visits(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """Each row with the rings that surely hold `wanted` rows near it."""
    rings: Rings = index.rings
    return metric_index.visits(queries, len(rings), lambda x, _: rings.home(x, wanted))


def later_visits(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """Each row with the other rings that can hold a row within its `reach` (NULL: any), which it has from the first ones."""
    return metric_index.visits(queries, len(index.rings), _later(index.rings, wanted))


def _later(rings: Rings, wanted: int):
    def wants(x: np.ndarray, batch: pd.DataFrame) -> np.ndarray:
        reach = batch["reach"].fillna(np.inf).to_numpy()
        return (rings.bounds(x)[0] <= reach[:, None]) & ~rings.home(x, wanted)

    return wants


def _best_of_tile(left: DataFrame, right: DataFrame, k: int, skip_self: bool):
    """The nearest k of a block of donors for each row of a block that wants their rings, none farther than its `reach`."""
    columns = ["key", "donor", "gap", "label"]

    def best(a: pd.DataFrame, b: pd.DataFrame, masks) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in columns})
        b = b.iloc[np.argsort(b["key"].to_numpy(), kind="stable")]
        b = b.iloc[np.argsort(b["ring"].to_numpy(), kind="stable")]
        keys, names, labels = a["key"].to_numpy(), b["key"].to_numpy(), b["label"].to_numpy(dtype=float)
        x, y = stacked(a["features"]), stacked(b["features"])
        limit = np.square(a["reach"].to_numpy(dtype=float)) * (1 + 1e-12)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0

        def reduced() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows, flat, gaps = (np.concatenate(v) for v in zip(*kept))
            order = np.lexsort((rank[flat], gaps, rows))
            rows, flat, gaps = rows[order], flat[order], gaps[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            last = place == k - 1
            limit[rows[last]] = np.minimum(limit[rows[last]], np.square(gaps[last]) * (1 + 1e-12))
            return [(rows[place < k], flat[place < k], gaps[place < k])]

        for screen, rows, low, high in metric_index.screened(x, y, b["ring"].to_numpy(), masks(a)):
            parts = screen.parts(rows, low, high)
            open_ended = np.flatnonzero(~np.isfinite(limit[rows]))
            if len(open_ended) and high - low >= k:
                some = parts[open_ended]
                if skip_self:
                    some[keys[rows[open_ended], None] == names[None, low:high]] = np.inf
                ends = np.partition(some, k - 1, axis=1)[:, k - 1]
                limit[rows[open_ended]] = screen.squared(rows[open_ended], ends.astype(float))
            row, flat = np.nonzero(parts <= screen.above(rows, limit[rows]))
            row, flat = rows[row], flat + low
            if skip_self:
                other = keys[row] != names[flat]
                row, flat = row[other], flat[other]
            gaps = metric_index.gaps_of(x, y, row, flat)
            kept.append((row, flat, gaps))
            waiting += len(row)
            if waiting > max(500_000, 2 * k * len(x)):
                kept = reduced()
                waiting = 0
        rows, flat, gaps = reduced()[0]
        return pd.DataFrame({"key": keys[rows], "donor": names[flat], "gap": gaps, "label": labels[flat]})

    kinds = left.schema["key"].dataType.simpleString(), right.schema["key"].dataType.simpleString()
    return best, f"key {kinds[0]}, donor {kinds[1]}, gap double, label double"


def first_k(gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest entries of each row, by entry and then by column."""
    if gaps.shape[1] <= k:
        return np.repeat(np.arange(len(gaps)), gaps.shape[1]), np.tile(np.arange(gaps.shape[1]), len(gaps))
    limit = np.partition(gaps, k - 1, axis=1)[:, k - 1]
    rows, flat = np.nonzero(gaps <= limit[:, None])
    order = np.lexsort((flat, gaps[rows, flat], rows))
    rows, flat = rows[order], flat[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[kept], flat[kept]


class NearestNeighbours:
    """Vote or mean of the k nearest training rows. The model is the training table itself."""

    def __init__(self, task: str, n_neighbors: int = 5, block_rows: int = BLOCK_ROWS):
        self.task, self.k, self.block_rows = task, n_neighbors, block_rows
        self.rows: DataFrame | None = None

    def fit(self, df: DataFrame) -> "NearestNeighbours":
        key = F.xxhash64(as_array(df, "features"), F.col("label")) if "key" not in df.columns else F.col("key")
        self.rows = df.select(key.alias("key"), "features", F.col("label").cast("double").alias("label"))
        self.classes = int(self.rows.agg(F.max("label")).first()[0]) + 1 if self.task == "classification" else 0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """A class vote takes the smaller class on a tie. Rows without a `key` column are numbered and written first."""
        if "key" not in df.columns:
            numbered = cut_lineage(df.withColumn("key", F.monotonically_increasing_id()))
            return self.transform(numbered).drop("key")
        near = nearest(df, self.rows, self.k, block_rows=self.block_rows)
        if self.task == "regression":
            found = near.groupBy("key").agg(F.avg("label").alias("prediction"))
            return df.join(found, "key")
        votes = near.groupBy("key").agg(
            *[F.avg((F.col("label") == float(c)).cast("double")).alias(f"p{c}") for c in range(self.classes)]
        )
        shares = F.array(*[F.col(f"p{c}") for c in range(self.classes)])
        best = (F.array_position(shares, F.array_max(shares)) - 1).cast("double")
        found = votes.select("key", best.alias("prediction"), array_to_vector(shares).alias("probability"))
        return df.join(found, "key")
