"""A metric index with pivots: which blocks of rows can hold what a row looks for, and meetings of rows with those blocks only.

Every row goes to the cell of its nearest pivot, and a large cell is cut into rings by the distance to the pivot. A ring keeps its
least and largest distance; by the triangle inequality a row at distance d from the pivot has nothing nearer than d - largest or
least - d in it, so a ring beyond the gap that still matters to a row is never looked at. A ring with more rows than a block, such as
many equal rows, is dealt into blocks by a hash of the key, and so are the rows that visit it: no cell, ring or popular neighbourhood
is one task. Where nothing can be skipped (many dimensions without structure) every row meets every block, which is exact and quadratic.

`tiles` is the form for such tables: blocks of near rows meet blocks of near rings, so a row is shipped once per block and not once per
ring, and `Screen` rules out nearly all pairs of a tile by one matrix product before distances are taken by differences.

What the driver holds is bounded: at most `PIVOTS` pivots and `PIVOTS` x `RINGS` rings.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from modelyard.session import cut_lineage

PIVOTS, RINGS = 4096, 64
CELL_ROWS, BLOCK_ROWS = 1000, 4000
# Most rows of a side of a tile, and most pairs that are screened at a time.
TILE_ROWS, SCREEN_PAIRS = 32_000, 1_000_000


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def squares(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows and pivots by one product, and how far rounding can have moved them."""
    sizes = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    return np.maximum(sizes - 2 * (x @ pivots.T), 0.0), 8 * (x.shape[1] + 2) * np.finfo(float).eps * sizes


@dataclass(frozen=True)
class Rings:
    """The rings of an index: cell, rows, least and largest distance to the cell's pivot. The number of a ring is its place here."""

    pivots: np.ndarray
    cell: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.cell)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and ring: no row of the ring is nearer than the first, none is farther than the second."""
        square, error = squares(x, self.pivots)
        near, far = np.sqrt(np.maximum(square - error, 0.0))[:, self.cell], np.sqrt(square + error)[:, self.cell]
        slack = 1e-12 * (far + self.high)
        return np.maximum(np.maximum(near - self.high, self.low - far) - slack, 0.0), far + self.high + slack

    def home(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """For each row a few rings that hold at least `wanted` rows near it, as a mask."""
        _, upper = self.bounds(x)
        order = np.argsort(upper, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mask = np.zeros(upper.shape, bool)
        np.put_along_axis(mask, order, before < wanted, axis=1)
        return mask


@dataclass(frozen=True)
class Index:
    """`rows` (key, features, ring and any other columns) and what is known of their rings."""

    rows: DataFrame
    rings: Rings


def build(rows: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, most: int = PIVOTS) -> Index:
    """Index `rows`, which have `key` and `features` (array of double); rows without, or with NULL, NaN or infinite ones, are left out."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(F.col("features").isNotNull() & F.forall("features", finite))
    pivots = _pivots(rows, min(most, ceil(rows.count() / cell_rows)))
    if not len(pivots):
        nothing = np.zeros(0)
        return Index(rows.withColumn("ring", F.lit(0)), Rings(np.zeros((0, 0)), nothing.astype(int), nothing.astype(int), nothing, nothing))

    def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = stacked(batch["features"])
                cell = home_cells(x, pivots)
                gap = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield batch.assign(cell=cell.astype(np.int32), gap=gap)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = cut_lineage(rows.mapInPandas(nearest, f"{schema}, cell int, gap double"))
    shares = [i / RINGS for i in range(1, RINGS)]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gap", shares, 10_000).alias("cuts")).collect()
    # Evenly spaced ones of the 63 cuts; a small cell is one ring.
    edges = {r["cell"]: np.unique(np.array(r["cuts"])[np.arange(1, k) * RINGS // k - 1]) for r in cells if (k := min(RINGS, ceil(r["n"] / block_rows))) > 1}

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ring = np.zeros(len(batch), np.int64)
            for cell in set(batch["cell"]) & set(edges):
                own = (batch["cell"] == cell).to_numpy()
                ring[own] = np.searchsorted(edges[cell], batch["gap"].to_numpy()[own])
            yield batch.assign(ring=(batch["cell"].to_numpy() * RINGS + ring).astype(np.int32))

    ringed = placed.mapInPandas(cut, f"{schema}, cell int, gap double, ring int") if edges else placed.withColumn("ring", F.col("cell") * RINGS)
    ringed = cut_lineage(ringed)
    known = ringed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).orderBy("ring").toPandas()
    # At most PIVOTS x RINGS rows of two numbers.
    table = pd.DataFrame({"ring": known["ring"], "_i": np.arange(len(known), dtype=np.int32)})
    numbers = F.broadcast(ringed.sparkSession.createDataFrame(table, "ring int, _i int"))
    coded = ringed.join(numbers, "ring").drop("ring").withColumnRenamed("_i", "ring")
    arrays = (known["ring"].to_numpy() // RINGS, known["n"].to_numpy(), known["low"].to_numpy(), known["high"].to_numpy())
    return Index(coded.drop("cell", "gap"), Rings(pivots, *arrays))


def home_cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row."""
    return np.concatenate([squares(x[i : i + 2000], pivots)[0].argmin(axis=1) for i in range(0, len(x), 2000)])


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Rows of the table, taken by a hash of the key."""
    if not count:
        return np.zeros((0, 0))
    lean = rows.select("features", F.xxhash64(F.col("key").cast("string")).alias("h")).orderBy("h").limit(count)
    found = np.array([r["features"] for r in lean.collect()], dtype=float)
    return np.unique(found, axis=0)


def pieces(batch: pd.DataFrame, rings: int) -> Iterator[pd.DataFrame]:
    """A batch in pieces of which a table of rows and rings stays small."""
    step = max(1, min(500, 4_000_000 // max(1, rings)))
    return (batch.iloc[i : i + step] for i in range(0, len(batch), step))


def visits(queries: DataFrame, rings: int, wants: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """`queries` once for every one of the `rings` in the mask `wants(features, rows)`, with that `ring`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in pieces(batch, rings):
                row, ring = np.nonzero(wants(stacked(piece["features"]), piece))
                yield piece.iloc[row].assign(ring=ring.astype(np.int32))

    return queries.mapInPandas(run, f"{schema}, ring int")


def meet(
    visitors: DataFrame, rows: DataFrame, summary: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """`summary(visitors, rows)` for every ring that has visitors, in blocks of about `block_rows` on both sides.

    Both tables have `key` and `ring`. The ring sizes are at most PIVOTS x RINGS rows and are broadcast.
    """
    visitors = cut_lineage(visitors)
    sizes = visitors.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_chunks"))
    blocks = rows.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_salts"))
    plan = F.broadcast(cut_lineage(sizes.join(blocks, "ring")))
    dealt = lambda n: F.pmod(F.xxhash64(F.col("key").cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visitors.join(plan, "ring").withColumn("_chunk", dealt("_chunks")).withColumn("_salt", every("_salts")).drop("_chunks", "_salts")
    right = rows.join(plan, "ring").withColumn("_salt", dealt("_salts")).withColumn("_chunk", every("_chunks")).drop("_chunks", "_salts")
    by = ("ring", "_salt", "_chunk")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(summary, schema)


def best(found: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first `k` rows of each group; Spark keeps no more than `k` of a group on the way."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


class Screen:
    """Pairs of two blocks that can be, or surely are, within a squared limit: one product in single precision, with its rounding bounded.

    Rows are moved to the middle of the right block and scaled to size 1 first, which keeps that bound small.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        self.scale = max(float(np.abs(x).max(initial=0.0)), float(np.abs(y).max(initial=0.0))) or 1.0
        x, y = x / self.scale, y / self.scale
        sizes = (y * y).sum(axis=1)
        self.own = (x * x).sum(axis=1)
        self.slack = 4 * (x.shape[1] + 4) * float(np.finfo(np.float32).eps) * (self.own + sizes.max(initial=0.0)) + 1e-30
        self.left = np.hstack([-2 * x, np.ones((len(x), 1))]).astype(np.float32)
        self.right = np.hstack([y, sizes[:, None]]).astype(np.float32).T.copy()

    def parts(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of `rows` and the columns from `start` to `end`: the squared distances less the own square of the row."""
        return self.left[rows] @ self.right[:, start:end]

    def above(self, rows: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """What `parts` of pairs within the squared limits do not exceed."""
        return (squared / self.scale**2 - self.own[rows] + self.slack[rows]).astype(np.float32)[:, None]

    def below(self, rows: np.ndarray, squared: np.ndarray) -> np.ndarray:
        """What only `parts` of pairs within the squared limits do not exceed."""
        return (squared / self.scale**2 - self.own[rows] - self.slack[rows]).astype(np.float32)[:, None]

    def squared(self, rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The largest squared distance that a row with such a part can have."""
        return (parts + self.own[rows] + self.slack[rows]) * self.scale**2


def gaps_of(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, by differences."""
    out = np.empty(len(rows))
    step = max(1, 1_000_000 // max(1, x.shape[1]))
    for start in range(0, len(rows), step):
        gap = x[rows[start : start + step]] - y[columns[start : start + step]]
        out[start : start + step] = np.sqrt(np.einsum("ik,ik->i", gap, gap))
    return out


def walk(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which near ones are mostly near: halves along the widest dimension, and so on."""
    order, out = [np.arange(len(pivots))], []
    while order:
        own = order.pop()
        if len(own) < 3:
            out.append(own)
            continue
        x = pivots[own]
        own = own[np.argsort(x[:, np.argmax(x.max(axis=0) - x.min(axis=0))], kind="stable")]
        order += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out) if out else np.zeros(0, int)


def _dealt(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Blocks of at most `most` rows from groups in order: the first block of each group, its blocks, and the places of each block in `order`."""
    first, count, runs, filled = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), [], most
    for place, group in enumerate(order):
        n = int(sizes[group])
        if n > most:
            first[group], count[group], filled = len(runs), ceil(n / most), most
            runs += [(place, place + 1)] * int(count[group])
        elif not runs or filled + n > most:
            first[group], filled = len(runs), n
            runs.append((place, place + 1))
        else:
            first[group], filled = len(runs) - 1, filled + n
            runs[-1] = (runs[-1][0], place + 1)
    return first, count, runs


def tiles(
    queries: DataFrame, index: Index, wants: Callable[[np.ndarray, pd.DataFrame], np.ndarray],
    summary: Callable[[pd.DataFrame, pd.DataFrame, Callable], pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS, rows: DataFrame | None = None,
) -> DataFrame:
    """`summary(queries, rows, masks)` for blocks of `queries` (key, features, ...) that can meet blocks of the index.

    Queries lie in blocks by their nearest pivot and rows by their ring; a cell or ring of more rows than a block is dealt by a hash of the key.
    `wants(features, queries)` is the mask of rings of each query; two blocks without any wanted ring never meet. Inside a tile
    `masks(queries)` is that mask again, for the rings of all rows. A block has at least `block_rows` rows, if there are so many, and
    at most `TILE_ROWS`, so that a row is copied at most once per block of the other side. `rows` stands for those of the index, with its rings.
    """
    rings, rows = index.rings, index.rows if rows is None else rows
    spark = queries.sparkSession
    schema_of = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    pivots = rings.pivots

    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(_cell=home_cells(stacked(batch["features"]), pivots).astype(np.int32))

    placed = cut_lineage(queries.where("features IS NOT NULL").mapInPandas(home, f"{schema_of(queries)}, _cell int"))
    known = placed.groupBy("_cell").count().toPandas()
    sizes = np.zeros(len(pivots), int)
    sizes[known["_cell"]] = known["count"]
    most = lambda n: max(block_rows, min(TILE_ROWS, ceil(int(n) / 6)))
    order = walk(pivots)
    place = np.empty(len(pivots), int)
    place[order] = np.arange(len(pivots))
    ring_order = np.argsort(place[rings.cell], kind="stable")
    q_first, q_count, _ = _dealt(sizes, order, most(sizes.sum()))
    d_first, d_count, runs = _dealt(rings.rows, ring_order, most(rings.rows.sum()))
    starts, ends = np.array([a for a, _ in runs]), np.array([b for _, b in runs])

    # Tables of at most PIVOTS, or PIVOTS x RINGS, rows.
    def table(first: np.ndarray, count: np.ndarray, name: str) -> DataFrame:
        made = pd.DataFrame({name: np.arange(len(first), dtype=np.int32), "_first": first, "_count": count})
        return F.broadcast(spark.createDataFrame(made, f"{name} int, _first int, _count int"))

    block = (F.col("_first") + F.pmod(F.xxhash64(F.col("key").cast("string")), F.col("_count"))).cast("int")
    left = placed.join(table(q_first, q_count, "_cell"), "_cell").withColumn("_q", block).drop("_cell", "_first", "_count")
    right = rows.join(table(d_first, d_count, "ring"), "ring").withColumn("_d", block).drop("_first", "_count")

    def met(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in pieces(batch, len(rings)):
                mask = wants(stacked(piece["features"]), piece)[:, ring_order]
                upto = np.hstack([np.zeros((len(mask), 1), int), np.cumsum(mask, axis=1)])
                row, d = np.nonzero(upto[:, ends] > upto[:, starts])
                found |= set(zip(piece["_q"].to_numpy()[row].tolist(), d.tolist()))
        yield pd.DataFrame(sorted(found), columns=["_q", "_d"]).astype(np.int32)

    # As many rows as pairs of blocks.
    plan = F.broadcast(cut_lineage(left.mapInPandas(met, "_q int, _d int").distinct()))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def masks(some: pd.DataFrame) -> np.ndarray:
            own = np.unique(b["ring"].to_numpy())
            parts = [wants(stacked(piece["features"]), piece)[:, own] for piece in pieces(some, len(rings))]
            out = np.zeros((len(some), len(rings)), bool)
            out[:, own] = np.concatenate(parts) if parts else False
            return out

        return summary(a, b, masks)

    by = ("_q", "_d")
    return left.join(plan, "_q").groupBy(*by).cogroup(right.join(plan, "_d").groupBy(*by)).applyInPandas(run, schema)


def screened(x: np.ndarray, y: np.ndarray, ring: np.ndarray, mask: np.ndarray) -> Iterator[tuple["Screen", np.ndarray, int, int]]:
    """The screen, rows, and columns (from, to) of the pieces of a tile: `ring` of the columns is sorted, `mask` says which rows want a ring."""
    screen = Screen(x, y)
    edges = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1], True]) if len(ring) else np.zeros(1, int)
    for start, end in zip(edges[:-1], edges[1:]):
        wanting = np.flatnonzero(mask[:, ring[start]])
        for low in range(start, end, 4000):
            high = min(end, low + 4000)
            step = max(1, SCREEN_PAIRS // (high - low))
            for i in range(0, len(wanting), step):
                yield screen, wanting[i : i + step], low, high
