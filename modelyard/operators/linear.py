"""Linear classifiers from class sums: one aggregate, one p x p solve."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import as_array, pack_sums
from modelyard.operators.plain import PlainModel, with_linear_prediction


def _class_moments(df: DataFrame) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
    """Classes, counts, sum vectors and the pooled cross products around the overall mean, and that mean."""
    rows = df.select(F.col("label").cast("double").alias("label"), as_array(df, "features").alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("the table is empty")
    sums = pack_sums(rows, "label", "x", first["x"])
    classes = sorted(sums)
    counts = np.array([sums[c][0] for c in classes], dtype=float)
    shift = np.asarray(first["x"], dtype=float)
    totals = np.array([sums[c][1] for c in classes])
    cross = sum(sums[c][2] for c in classes)
    return classes, counts, totals, cross, shift


class LinearDiscriminant(PlainModel):
    """Gaussian classes with one shared covariance."""

    state_names = ("weights", "offsets")

    def __init__(self, tolerance: float = 1e-8):
        self.tolerance = tolerance

    def fit(self, df: DataFrame) -> "LinearDiscriminant":
        classes, counts, totals, cross, shift = _class_moments(df)
        means = totals / counts[:, None]
        n, k = counts.sum(), len(classes)
        within = (cross - (means.T * counts) @ means) / (n - k)
        inverse = np.linalg.pinv(within, rcond=self.tolerance, hermitian=True)
        self.weights = means @ inverse
        self.offsets = np.log(counts / n) - 0.5 * np.einsum("ij,ij->i", self.weights, means) - self.weights @ shift
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = with_linear_prediction(df, self.weights, self.offsets)
        top = F.array_max("scores")
        powers = F.transform("scores", lambda s: F.exp(s - top))
        total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        return out.withColumn("probability", array_to_vector(F.transform(powers, lambda v: v / total))).drop("scores")


class RidgeVotes(PlainModel):
    """Ridge regression on +1/-1 per class; the largest value wins."""

    state_names = ("weights", "offsets")

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, df: DataFrame) -> "RidgeVotes":
        classes, counts, totals, cross, shift = _class_moments(df)
        n = counts.sum()
        mean = totals.sum(axis=0) / n
        gram = cross - n * np.outer(mean, mean) + self.alpha * np.eye(len(mean))
        signs = 2.0 * counts / n - 1.0
        # Sum of (x - mean) * y with y = +1 in the class and -1 elsewhere.
        target = 2.0 * (totals - counts[:, None] * mean)
        self.weights = np.linalg.solve(gram, target.T).T
        self.offsets = signs - self.weights @ (mean + shift)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return with_linear_prediction(df, self.weights, self.offsets).drop("scores")
