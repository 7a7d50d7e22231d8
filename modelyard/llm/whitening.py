"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

The entries of a vector are put on a grid of whole numbers, so sums per dimension are exact. Rows are written once on that grid; one
pass adds them up, one adds the products of centred rows, and both sums are made per task, then per group of tasks, and only a
d x d table reaches the driver (d is checked against `MOST_DIMENSIONS`). There the scatter A is factored with diagonal pivots into
L L', and plane rotations from the right make the columns of L orthogonal: their squared norms are the eigenvalues of A, and
the normalised columns its eigenvectors. Working on L and not on A keeps small eigenvalues accurate. The rotations of a step touch
disjoint pairs of columns and run together.

Defined results: rows whose vector is NULL, or has NULL, NaN or infinite entries, or entries too large for the grid, are left out.
Rows whose length is not the most frequent one (of equally frequent ones the longest) are left out: they have no place in one covariance. Components of
variance zero (to rounding) have no whitened value and no rows, so there are at most as many as the rank. A component's sign
makes its largest entry positive. A deviation that does not fit 64 bits is NULL. Repeated rows and ids count as often as they come. An
empty table, or one without variance, gives no rows.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from modelyard.llm.common import written

SCALE, OFFSET = 64, 1_000_000
# The grid's numbers stay exact as doubles below this.
LARGEST = float(1 << 46)
MOST_DIMENSIONS = 4096
SALTS = 64
# Rows of a matrix product at a time.
SLICE = 4096
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid_rows(vectors: DataFrame, identity: str, embedding: str) -> DataFrame:
    """`vec_id, x` (array of long) of the rows that count, written."""
    entry = F.col(f"`{embedding}`").cast("array<double>")
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)
    kept = vectors.where(entry.isNotNull() & F.forall(entry, usable))
    rows = kept.select(
        F.col(f"`{identity}`").cast("long").alias("vec_id"), F.transform(entry, lambda v: F.floor(v * SCALE) + OFFSET).alias("x")
    )
    rows = written(rows, "whitening-rows")
    # One row per length.
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return rows
    if lengths["d"] > MOST_DIMENSIONS:
        raise ValueError(f"{lengths['d']} dimensions, more than {MOST_DIMENSIONS}")
    return rows.where(F.size("x") == lengths["d"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _total(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, width: int, dtype) -> np.ndarray:
    """The sum over all rows of `of(x)`, a `width`-column table of few rows, in two levels: `SALTS` groups, then one."""
    kind, name = (pa.list_(pa.int64()), "array<long>") if np.issubdtype(dtype, np.integer) else (pa.list_(pa.float64()), "array<double>")

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for i in range(0, len(x), SLICE):
                own = of(x[i : i + SLICE]).astype(dtype, copy=False)
                sums = own if sums is None else sums + own
        if sums is not None:
            salt = TaskContext.get().partitionId() % SALTS
            columns = [pa.array([salt] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(list(sums), kind)]
            yield pa.RecordBatch.from_arrays(columns, ["salt", "i", "values"])

    def add(table: pa.Table) -> pa.Table:
        values = _matrix(table["values"].combine_chunks(), width).sum(axis=0, dtype=dtype)
        return pa.table({"salt": pa.array([0], pa.int32()), "i": table["i"][:1], "values": pa.array([values], kind)})

    schema = f"salt int, i int, values {name}"
    found = rows.select("x").mapInArrow(partial, schema).groupBy("i", "salt").applyInArrow(add, schema)
    # d rows of d numbers, d checked.
    final = found.groupBy("i").applyInArrow(add, schema).orderBy("i").toArrow()
    return _matrix(final["values"].combine_chunks(), width) if final.num_rows else np.zeros((0, width), dtype)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with A = L L': rows in the order of A, columns in the order of the pivots, as many as the rank."""
    d = len(a)
    rest = np.diag(a).copy()
    floor = rest.max(initial=0.0) * d * np.finfo(float).eps
    factor = np.zeros((d, d))
    for k in range(d):
        p = int(np.argmax(rest))
        if rest[p] <= floor or rest[p] <= 0:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0.0
        factor[:, k] = column
        rest = rest - column * column
        rest[p] = -np.inf
    return factor


def jacobi(factor: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and unit columns of `factor` after rotations that make its columns orthogonal, norms falling."""
    w = np.ascontiguousarray(factor.T)
    r = len(w)
    if r == 0:
        return np.zeros(0), factor
    players = list(range(r)) + [-1] * (r % 2)
    tolerance = r * np.finfo(float).eps
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = np.array([p for p in zip(players[:half], players[: half - 1 : -1]) if -1 not in p], int).reshape(-1, 2)
            # One round of a tournament: every pair meets once a sweep.
            players = [players[0], players[-1], *players[1:-1]]
            x, y = w[pairs[:, 0]], w[pairs[:, 1]]
            xx, yy, xy = (np.einsum("ij,ij->i", u, v) for u, v in ((x, x), (y, y), (x, y)))
            norm = np.sqrt(xx * yy)
            apart = np.divide(np.abs(xy), norm, out=np.zeros_like(xy), where=norm > 0)
            worst = max(worst, float(apart.max(initial=0.0)))
            turn = apart > tolerance
            if not turn.any():
                continue
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = (c * t)[:, None]
            c = c[:, None]
            first, second = x[turn], y[turn]
            w[pairs[turn, 0]] = c * first - s * second
            w[pairs[turn, 1]] = s * first + c * second
        if worst <= tolerance:
            break
    else:
        raise ArithmeticError("the rotations did not settle")
    values = np.einsum("ij,ij->i", w, w)
    order = np.argsort(-values, kind="stable")
    units = (w[order] / np.sqrt(values[order])[:, None]).T
    signs = np.sign(units[np.argmax(np.abs(units), axis=0), np.arange(r)])
    return values[order], units * signs


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: `n` rows, exact sums per dimension, eigenvalues of the covariance and unit components, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, with the whole part taken off first, so nothing is rounded before it is small."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def apply(self, x: np.ndarray, most: int) -> np.ndarray:
        k = min(most, len(self.values))
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; None where 64 bits are too few."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = [s % self.n for s in self.sums]
        far = x - whole
        reach = int(np.abs(far).max(initial=0)) + 1
        if x.shape[1] * (self.n * reach) ** 2 < 1 << 62:
            gaps = self.n * far - np.array(part, np.int64)
            return (gaps * gaps).sum(axis=1).tolist()
        exact = [sum((self.n * v - p) ** 2 for v, p in zip(row, part)) for row in far.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of `rows` (`vec_id, x`), or None without rows or variance."""
    head = rows.select(F.size("x").alias("d")).first()
    if head is None or head["d"] == 0:
        return None
    d = head["d"]
    # Halves of 32 bits, so that no sum of them overflows; the last column counts.
    low = lambda x: np.stack([(x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0), np.full(d, len(x))])
    parts = _total(rows, low, d, d, np.int64).tolist()
    n = parts[2][0]
    model = Whitening(n, [a + (b << 32) for a, b in zip(parts[0], parts[1])], np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        centred = model.centred(x)
        return centred.T @ centred

    covariance = _total(rows, products, d, d, np.float64) / n
    values, components = jacobi(pivoted_cholesky(covariance))
    return Whitening(n, model.sums, values, components, float(np.trace(covariance))) if len(values) else None


def identity_error(rows: DataFrame, model: Whitening, most: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, worked out from all rows."""
    d, k = len(model.sums), min(most, len(model.values))
    means = _total(rows, lambda x: model.apply(x, most).sum(0)[None, :], d, k, np.float64)[0] / model.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = model.apply(x, most) - means
        return centred.T @ centred

    covariance = _total(rows, products, d, k, np.float64) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, identity: str = "vec_id", embedding: str = "embedding", most: int = 32) -> DataFrame:
    """Fit on all usable rows of `vectors` and give each row's whitened values, one row per component, as `ROWS`."""
    rows = grid_rows(vectors, identity, embedding)
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], ROWS)
    error = identity_error(rows, model, most)
    k = min(most, len(model.values))
    explained = model.values[:k] / model.trace

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = _matrix(piece.column(1), len(model.sums))
                m = len(x)
                columns = {
                    "vec_id": pa.array(np.repeat(np.arange(m), k)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, model.n, np.int64)),
                    "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(model.apply(x, most).reshape(-1)),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
                columns["vec_id"] = piece.column(0).take(columns["vec_id"])
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select("vec_id", "x").mapInArrow(run, ROWS)
