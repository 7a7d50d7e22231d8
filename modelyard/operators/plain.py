"""Models whose whole state is a few numbers: kept as JSON."""

import json

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelyard.functions.vectors import as_array

KINDS: dict[str, type] = {}


class PlainModel:
    """Base of small models. A subclass sets its fields in `fit` and reads them in `transform`."""

    state_names: tuple[str, ...] = ()

    def __init_subclass__(cls):
        KINDS[cls.__name__] = cls

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"kind": type(self).__name__}
        for name in self.state_names:
            value = getattr(self, name)
            state[name] = value.tolist() if isinstance(value, np.ndarray) else value
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)


def restore(state: dict) -> PlainModel:
    """A model from its state."""
    kind = KINDS[state["kind"]]
    model = kind.__new__(kind)
    for name in kind.state_names:
        value = state[name]
        setattr(model, name, np.asarray(value, dtype=float) if isinstance(value, list) else value)
    return model


def load_plain(spark: SparkSession, path: str) -> PlainModel:
    return restore(json.loads(spark.read.text(path).first()["value"]))


def linear_scores(x: Column, weights: np.ndarray, offsets: np.ndarray) -> Column:
    """`weights @ x + offsets` as an array column, one entry per row of `weights`."""
    rows = F.array(
        *[
            F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b"))
            for w, b in zip(weights, offsets)
        ]
    )
    return F.transform(
        rows,
        lambda r: F.aggregate(F.zip_with(x, r["w"], lambda a, b: a * b), r["b"], lambda s, v: s + v),
    )


def best_class(scores: Column) -> Column:
    """Place of the largest score; the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def with_linear_prediction(df: DataFrame, weights: np.ndarray, offsets: np.ndarray) -> DataFrame:
    scores = linear_scores(as_array(df, "features"), weights, offsets)
    return df.withColumn("scores", scores).withColumn("prediction", best_class(F.col("scores")))


def projected(df: DataFrame, weights: np.ndarray, offsets: np.ndarray, output: str) -> DataFrame:
    return df.withColumn(output, array_to_vector(linear_scores(as_array(df, "features"), weights, offsets)))
