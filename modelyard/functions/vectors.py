"""Vector columns: unpacking, distances and cross products."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

JVM_GRAM_WIDTH = 16


def as_array(df: DataFrame, name: str) -> Column:
    """A vector or numeric-array column as array<double>."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(F.col(name))
    return F.col(name).cast("array<double>")


def as_vector(df: DataFrame, name: str) -> Column:
    """A vector or numeric-array column as an ML vector."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return F.col(name)
    return array_to_vector(F.col(name).cast("array<double>"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column and fixed weights."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(a, fixed, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def width_of(df: DataFrame, name: str) -> int:
    """Length of the vectors, from one row."""
    row = df.select(F.size(as_array(df, name)).alias("p")).first()
    if row is None:
        raise ValueError("the table is empty")
    return row["p"]


def assemble(columns: Sequence[str]) -> Column:
    """Numeric columns as one vector."""
    return array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))


def pack_sums(df: DataFrame, group: str, array: str, shift: Sequence[float] | None = None) -> dict:
    """Per group: row count, sum vector and cross-product matrix of an array column, as NumPy values.

    Only group-count x width^2 numbers reach the driver. Narrow vectors use JVM sums; wide ones use one NumPy
    product per Arrow batch and sum the partial matrices in a shuffle keyed by (group, matrix row).
    `shift` is subtracted first, which keeps the products well-conditioned.
    """
    df = df.select(F.col(group).alias("g"), F.col(array).alias("a"))
    p = width_of(df, "a")
    centre = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)
    if p <= JVM_GRAM_WIDTH:
        cells = [F.element_at("a", i + 1) - F.lit(float(centre[i])) for i in range(p)]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        rows = (
            df.select("g", *[c.alias(f"x{i}") for i, c in enumerate(cells)])
            .groupBy("g")
            .agg(
                F.count("*").alias("n"),
                *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
                *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in pairs],
            )
            .collect()
        )
        out = {}
        for row in rows:
            cross = np.zeros((p, p))
            for i, j in pairs:
                cross[i, j] = cross[j, i] = row[f"c{i}_{j}"]
            out[row["g"]] = (row["n"], np.array([row[f"s{i}"] for i in range(p)]), cross)
        return out

    group_type = df.schema["g"].dataType.simpleString()

    def partial(batches):
        for pdf in batches:
            for value, part in pdf.groupby("g", dropna=False):
                x = np.stack(part["a"].to_numpy()).astype(float) - centre
                wide = np.hstack([np.ones((len(x), 1)), x])
                product = wide.T @ wide
                yield pd.DataFrame({"g": [value] * (p + 1), "i": range(p + 1), "row": list(product)})

    sums = (
        df.mapInPandas(partial, f"g {group_type}, i int, row array<double>")
        .select("g", "i", F.posexplode("row").alias("j", "v"))
        .groupBy("g", "i", "j")
        .agg(F.sum("v").alias("v"))
        .groupBy("g", "i")
        .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
        .select("g", "i", F.col("row.v").alias("row"))
    )
    full: dict = {}
    for row in sums.toLocalIterator():
        full.setdefault(row["g"], np.zeros((p + 1, p + 1)))[row["i"]] = row["row"]
    return {g: (int(round(m[0, 0])), m[0, 1:], m[1:, 1:]) for g, m in full.items()}
