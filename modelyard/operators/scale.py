"""Fitted column transforms. A fit returns plain numbers per column; applying them is one projection."""

from collections.abc import Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.values import nan_to_null
from modelyard.operators.ordered import exact_percentiles


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "robust") -> dict[str, tuple[float, float]]:
    """(centre, width) per column; a zero width becomes 1. Methods: robust, standard, minmax, maxabs."""
    columns = list(columns)
    if method == "robust":
        quarters = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
        found = {c: (q[1], q[2] - q[0]) for c, q in quarters.items() if q[1] is not None}
    else:
        makers = {
            "standard": lambda v: (F.avg(v), F.stddev_pop(v)),
            "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)),
            "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
        }
        if method not in makers:
            raise ValueError(f"unknown scaler {method}")
        cells = []
        for i, c in enumerate(columns):
            value = F.col(f"`{c}`").cast("double")
            centre, width = makers[method](F.when(~F.isnan(value), value))
            cells += [centre.alias(f"c{i}"), width.alias(f"w{i}")]
        row = df.agg(*cells).first()
        found = {c: (row[f"c{i}"], row[f"w{i}"]) for i, c in enumerate(columns) if row[f"w{i}"] is not None}
    return {c: (float(m), float(w) if w else 1.0) for c, (m, w) in found.items()}


def apply_scaler(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`").cast("double") - m) / w for c, (m, w) in fitted.items()})


def yeo_johnson(column, lam: float):
    """The Yeo-Johnson transform of a column for a given lambda."""
    x = column.cast("double")
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


MOMENTS = ["n", "low", "high", "logs", "mean", "square"]


def _powers(u: np.ndarray, lam: float) -> np.ndarray:
    """((1 + x)^lam - 1) / lam from u = log1p(x)."""
    return u if abs(lam) < 1e-12 else np.expm1(lam * u) / lam


def _moments(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """MOMENTS of the transformed values for each lambda: rows, range of x, sum of signed logarithms, mean, squares about it."""
    x = np.concatenate([x[x >= 0], x[x < 0]])
    ups = int((x >= 0).sum())
    u = np.log1p(np.abs(x))
    logs = u[:ups].sum() - u[ups:].sum()
    out = np.empty((len(grid), len(MOMENTS)))
    for j, g in enumerate(grid):
        y = np.concatenate([_powers(u[:ups], g), -_powers(u[ups:], 2 - g)]) if ups < len(x) else _powers(u, g)
        y = y - (first := y[0])
        mean = y.mean()
        out[j] = len(x), x.min(), x.max(), logs, mean + first, ((y - mean) ** 2).sum()
    return out


def _merged(parts: np.ndarray) -> np.ndarray:
    """Moments (parts x lambdas x MOMENTS) of all parts together."""
    n, low, high, logs, mean, square = np.moveaxis(parts, 2, 0)
    first = mean[0]
    middle = first + (n * (mean - first)).sum(axis=0) / n.sum(axis=0)
    square = (square + n * (mean - middle) ** 2).sum(axis=0)
    return np.stack([n.sum(axis=0), low.min(axis=0), high.max(axis=0), logs.sum(axis=0), middle, square], axis=1)


def _grid_moments(df: DataFrame, grids: dict[str, np.ndarray]) -> dict[tuple[int, int], tuple[float, float]]:
    """(variance, mean signed logarithm) of each column and lambda in one pass: a few numbers a task, merged per column."""

    def measure(batches):
        found: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for i, (c, grid) in enumerate(grids.items()):
                    x = batch[c].to_numpy(dtype=float)
                    if len(x := x[~np.isnan(x)]):
                        own = _moments(x, grid)
                        found[i] = _merged(np.stack([found[i], own])) if i in found else own
        for i, rows in found.items():
            yield pd.DataFrame(rows, columns=MOMENTS).assign(i=i, j=range(len(rows)))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            rows = _merged(parts[MOMENTS].to_numpy()[:, None, :])
        return pd.DataFrame(rows, columns=MOMENTS).assign(i=parts["i"].iloc[0], j=parts["j"].iloc[0])

    schema = ", ".join(f"{c} double" for c in MOMENTS) + ", i int, j int"
    rows = df.mapInPandas(measure, schema).groupBy("i", "j").applyInPandas(merge, schema).collect()
    # Equal values have no variance, whatever rounding says.
    return {(r["i"], r["j"]): (0.0 if r["low"] == r["high"] else r["square"] / r["n"], r["logs"] / r["n"]) for r in rows}


def fit_power(df: DataFrame, columns: Sequence[str], low: float = -2.0, high: float = 4.0, rounds: int = 5) -> dict:
    """(lambda, mean, deviation) per column: lambda maximises the likelihood on a grid that is refined `rounds` times.

    Every round is one pass that evaluates the whole grid of all columns; the last grid step is (high - low) / 8 / 4^rounds.
    NULL and NaN are left out; a column without values keeps lambda, mean 0 and deviation 1.
    """
    columns = list(columns)
    df = nan_to_null(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))
    centre = {c: (low + high) / 2 for c in columns}
    half = (high - low) / 2
    for _ in range(rounds):
        grids = {c: np.linspace(centre[c] - half, centre[c] + half, 9) for c in columns}
        found = _grid_moments(df, grids)
        for i, c in enumerate(columns):
            scores = [
                -0.5 * log(v) + (g - 1) * s if v else float("-inf")
                for g, (v, s) in zip(grids[c], (found.get((i, j), (None, None)) for j in range(len(grids[c]))))
            ]
            centre[c] = float(grids[c][int(np.argmax(scores))])
        half /= 4
    cells = []
    for i, c in enumerate(columns):
        y = yeo_johnson(F.col(f"`{c}`"), centre[c])
        cells += [F.avg(y).alias(f"m{i}"), F.stddev_pop(y).alias(f"d{i}")]
    row = df.agg(*cells).first()
    return {c: (centre[c], row[f"m{i}"] or 0.0, row[f"d{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_power(df: DataFrame, fitted: dict) -> DataFrame:
    """Transform, then bring to mean 0 and deviation 1."""
    return df.withColumns({c: (yeo_johnson(F.col(f"`{c}`"), lam) - m) / d for c, (lam, m, d) in fitted.items()})
