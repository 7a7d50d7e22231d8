"""Dimension reduction: projections from p x p moments, and fixed-point fits of one distributed sum per round."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from modelyard import settings
from modelyard.functions.vectors import as_array, pack_sums, width_of
from modelyard.operators.plain import PlainModel, projected


def _moments(df: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix around the mean."""
    rows = df.select(F.lit(0).alias("g"), as_array(df, "features").alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("the table is empty")
    n, total, cross = pack_sums(rows, "g", "x", first["x"])[0]
    mean = total / n
    return n, mean + np.asarray(first["x"]), cross - n * np.outer(mean, mean)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive, so that a fit is repeatable."""
    top = np.abs(vectors).argmax(axis=1)
    return vectors * np.sign(vectors[np.arange(len(vectors)), top])[:, None]


def sum_blocks(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of a matrix computed per Arrow batch; one small row per task and cell reaches the shuffle."""
    rows = df.select(as_array(df, "features").alias("x"))

    def partial(batches):
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += part(np.stack(pdf["x"].to_numpy()).astype(float))
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = rows.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(int(np.prod(shape)))
    for row in sums:
        out[row["i"]] = row["v"]
    return out.reshape(shape)


class PrincipalComponents(PlainModel):
    """Projection of the centred rows on the leading eigenvectors of the covariance."""

    state_names = ("components", "mean", "explained_variance", "explained_ratio")

    def __init__(self, n_components: int | None = None):
        self.n_components = n_components

    def fit(self, df: DataFrame) -> "PrincipalComponents":
        n, mean, scatter = _moments(df)
        values, vectors = np.linalg.eigh(scatter / (n - 1))
        order = np.argsort(values)[::-1][: self.n_components]
        self.components = _signed(vectors[:, order].T)
        self.mean = mean
        self.explained_variance = np.clip(values[order], 0, None)
        self.explained_ratio = self.explained_variance / max(values.clip(0).sum(), np.finfo(float).tiny)
        return self

    def transform(self, df: DataFrame, output: str = "reduced") -> DataFrame:
        return projected(df, self.components, -self.components @ self.mean, output)


class SingularVectors(PlainModel):
    """Projection of the rows, not centred, on the leading right singular vectors."""

    state_names = ("components", "singular_values")

    def __init__(self, n_components: int = 2):
        self.n_components = n_components

    def fit(self, df: DataFrame) -> "SingularVectors":
        n, mean, scatter = _moments(df)
        values, vectors = np.linalg.eigh(scatter + n * np.outer(mean, mean))
        order = np.argsort(values)[::-1][: self.n_components]
        self.components = _signed(vectors[:, order].T)
        self.singular_values = np.sqrt(np.clip(values[order], 0, None))
        return self

    def transform(self, df: DataFrame, output: str = "reduced") -> DataFrame:
        return projected(df, self.components, np.zeros(len(self.components)), output)


class FastICA(PlainModel):
    """Independent components: whitening, then symmetric fixed-point rounds with the log-cosh contrast."""

    state_names = ("components", "mean")

    def __init__(self, n_components: int | None = None, max_iter: int = 200, tolerance: float = 1e-4, seed: int = settings.RANDOM_STATE):
        self.n_components, self.max_iter, self.tolerance, self.seed = n_components, max_iter, tolerance, seed

    def fit(self, df: DataFrame) -> "FastICA":
        n, mean, scatter = _moments(df)
        values, vectors = np.linalg.eigh(scatter / n)
        order = [i for i in np.argsort(values)[::-1] if values[i] > 1e-15 * values.max()][: self.n_components]
        white = vectors[:, order].T / np.sqrt(values[order])[:, None]
        k = len(order)
        turn = _orthogonal(np.random.default_rng(self.seed).normal(size=(k, k)))
        rows = df.select("features").persist()
        try:
            for _ in range(self.max_iter):

                def part(x, turn=turn):
                    z = (x - mean) @ white.T
                    g = np.tanh(z @ turn.T)
                    return np.hstack([g.T @ z, (1 - g**2).sum(axis=0)[:, None]])

                total = sum_blocks(rows, part, (k, k + 1)) / n
                following = _orthogonal(total[:, :k] - total[:, k:] * turn)
                change = np.max(np.abs(np.abs(np.einsum("ij,ij->i", following, turn)) - 1))
                turn = following
                if change < self.tolerance:
                    break
        finally:
            rows.unpersist()
        self.components = _signed(turn @ white)
        self.mean = mean
        return self

    def transform(self, df: DataFrame, output: str = "reduced") -> DataFrame:
        return projected(df, self.components, -self.components @ self.mean, output)


def _orthogonal(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1.0 / np.sqrt(values)) @ vectors.T @ w


def _row_factors(x: np.ndarray, h: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative W that brings W H close to x, by coordinate descent per row: depends on the row and H only."""
    gram, target = h @ h.T, x @ h.T
    w = np.zeros((len(x), len(h)))
    for _ in range(sweeps):
        for c in range(len(h)):
            if gram[c, c] > 0:
                w[:, c] = np.maximum(0.0, w[:, c] + (target[:, c] - w @ gram[:, c]) / gram[c, c])
    return w


class NonNegativeFactors(PlainModel):
    """Non-negative factors. The row factors follow from H, so a round is one pass that sums W'X and W'W."""

    state_names = ("components", "sweeps")

    def __init__(self, n_components: int = 2, max_iter: int = 30, tolerance: float = 1e-4, sweeps: int = 10, seed: int = settings.RANDOM_STATE):
        self.n_components, self.max_iter, self.tolerance = n_components, max_iter, tolerance
        self.sweeps, self.seed = sweeps, seed

    def fit(self, df: DataFrame) -> "NonNegativeFactors":
        p, k, sweeps = width_of(df, "features"), self.n_components, self.sweeps
        lowest = df.select(F.array_min(as_array(df, "features")).alias("m")).agg(F.min("m"), F.count("*")).first()
        if lowest[0] < 0:
            raise ValueError("non-negative factors need features >= 0")
        mean = sum_blocks(df, lambda x: x.sum(axis=0), (p,)) / lowest[1]
        h = np.random.default_rng(self.seed).uniform(0.5, 1.5, size=(k, p)) * np.maximum(mean, 1e-12)
        rows = df.select("features").persist()
        try:
            for _ in range(self.max_iter):

                def part(x, h=h):
                    w = _row_factors(x, h, sweeps)
                    return np.hstack([w.T @ x, w.T @ w])

                total = sum_blocks(rows, part, (k, p + k))
                cross, gram = total[:, :p], total[:, p:]
                following = h.copy()
                for _ in range(sweeps):
                    for c in range(k):
                        if gram[c, c] > 0:
                            step = (cross[c] - gram[c] @ following) / gram[c, c]
                            following[c] = np.maximum(0.0, following[c] + step)
                change = np.linalg.norm(following - h) / max(np.linalg.norm(h), 1e-300)
                h = following
                if change < self.tolerance:
                    break
        finally:
            rows.unpersist()
        self.components = h
        return self

    def transform(self, df: DataFrame, output: str = "reduced") -> DataFrame:
        h, sweeps = self.components, int(self.sweeps)

        def factors(rows: pd.Series) -> pd.Series:
            return pd.Series(list(_row_factors(np.stack(rows.to_numpy()).astype(float), h, sweeps)))

        return df.withColumn(output, array_to_vector(pandas_udf(factors, "array<double>")(as_array(df, "features"))))
