"""Feature importance, Shapley values and learning curves."""

import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelyard import settings
from modelyard.functions.vectors import as_array
from modelyard.operators.split import draw


def importance_values(model) -> list[float] | None:
    """Raw importances: those of trees, else absolute weights (mean over classes); None where there are none."""
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in np.abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(v) for v in np.abs(model.coefficients.toArray())]
    if hasattr(model, "models"):
        parts = [importance_values(m) for m in model.models]
        return [float(v) for v in np.mean(parts, axis=0)] if all(p is not None for p in parts) else None
    if hasattr(model, "trees") and hasattr(model, "weights"):
        parts = np.array([importance_values(t) for t in model.trees])
        return [float(v) for v in np.average(parts, axis=0, weights=model.weights)]
    if hasattr(model, "weights"):
        return [float(v) for v in np.abs(model.weights).mean(axis=0)]
    return None


def feature_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """(feature_name, importance_score), scaled to sum 1 unless the sum is 0. The names must match the vector."""
    values = importance_values(model) or []
    if values and len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} names")
    total = sum(values)
    rows = [(n, v / total if total > 0 else v) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature_name string, importance_score double")


def linear_shapley(df: DataFrame, key: str, weights: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact values of a linear model on all rows: weight times distance from the mean."""
    x = as_array(df, "features")
    rows = df.select(F.col(key), x.alias("x"))
    means = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    cells = [
        F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.col("x")[i] - F.lit(means[i]))).alias("value"))
        for i, (n, w) in enumerate(zip(names, weights))
    ]
    return rows.select(key, F.inline(F.array(*cells)))


# Fixed value: rows that the permutations draw their background from.
BACKGROUND_ROWS = 100


def sampled_shapley(
    df: DataFrame,
    key: str,
    model,
    names: Sequence[str],
    sample_rows: int | None = None,
    permutations: int = 20,
    seed: int = settings.RANDOM_STATE,
    output: Callable[[DataFrame], object] | None = None,
) -> DataFrame:
    """(key, feature, value) for all given rows, or for `sample_rows` of them, any model.

    Every (row, permutation) switches from a background row to the row one feature at a time, and the change at each step belongs to
    the feature switched. The row itself is scored once and the background rows once for all; the mixtures between are scored in one
    `transform` and meet again by key. Background rows come from `sample_rows` rows drawn by hash, or from `BACKGROUND_ROWS` where all
    rows are explained.
    """
    p = len(names)
    rows = df.select(F.col(key).alias("key"), as_array(df, "features").alias("x"))
    sample = rows if sample_rows is None else rows.orderBy(draw(["key"], seed)).limit(sample_rows)
    drawn = BACKGROUND_ROWS if sample_rows is None else sample_rows
    background = [r["x"] for r in rows.orderBy(draw(["key"], seed + 1)).limit(drawn).collect()]
    rng = random.Random(seed)
    plans = []
    for j in range(permutations):
        order = list(range(p))
        rng.shuffle(order)
        plans.append((j, order, [float(v) for v in background[rng.randrange(len(background))]]))
    if output is None:
        output = lambda s: vector_to_array("probability")[1] if "probability" in s.columns else F.col("prediction")

    def scored(mixed: DataFrame, name: str) -> DataFrame:
        """`mixed` (x and others) with the model's output for x under `name`."""
        found = model.transform(mixed.withColumn("features", array_to_vector("x")))
        return found.select(*mixed.columns, output(found).cast("double").alias(name))

    bases = df.sparkSession.createDataFrame([(j, base) for j, _, base in plans], "key int, x array<double>")
    starts = {r["key"]: r["start"] for r in scored(bases, "start").collect()}
    # At step s the first s features of the order are the row's; `gains` was switched last, `loses` is switched next.
    steps = F.array(
        *[
            F.struct(
                F.lit(order[s - 1]).alias("gains"),
                F.lit(order[s] if s < p else -1).alias("loses"),
                F.lit(starts[j] if s == 1 else 0.0).cast("double").alias("start"),
                F.lit(s == p - 1).alias("last"),
                F.array(*[F.lit(order.index(i) < s) for i in range(p)]).alias("own"),
                F.array(*[F.lit(v) for v in base]).alias("base"),
            )
            for j, order, base in plans
            for s in range(1, max(2, p))
        ]
    )
    mix = F.array(*[F.when(F.get("own", F.lit(i)), F.get("x", F.lit(i))).otherwise(F.get("base", F.lit(i))) for i in range(p)])
    mixed = scored(sample, "whole").select("key", "x", "whole", F.inline(steps))
    mixed = scored(mixed.select("key", "whole", "gains", "loses", "start", "last", mix.alias("x")), "score")
    parts = [
        F.when(F.col("gains") == i, F.col("score") - F.col("start"))
        .when(F.col("loses") == i, F.when(F.col("last"), F.col("whole")).otherwise(0.0) - F.col("score"))
        for i in range(p)
    ]
    sums = mixed.groupBy("key").agg(*[(F.sum(part) / permutations).alias(f"v{i}") for i, part in enumerate(parts)])
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"v{i}").alias("value")) for i, n in enumerate(names)]
    return sums.select(F.col("key").alias(key), F.inline(F.array(*cells))).where("value IS NOT NULL")


def learning_curve(
    df: DataFrame,
    key: Sequence[str],
    make: Callable[[], object],
    score: Callable[[object, DataFrame], float],
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    folds: int = settings.CV_FOLDS,
    seed: int = settings.RANDOM_STATE,
) -> DataFrame:
    """Mean and deviation of train and validation scores per training size; the samples are nested by hash."""
    rows = df.withColumns({"_f": F.floor(draw(key, seed) * folds).cast("int"), "_s": draw(key, seed + 1)}).persist()
    found = []
    try:
        for fold in range(folds):
            rest, held = rows.where(F.col("_f") != fold), rows.where(F.col("_f") == fold)
            for size in sizes:
                train = rest.where(F.col("_s") < size)
                model = make().fit(train)
                found.append((float(size), float(score(model, train)), float(score(model, held))))
    finally:
        rows.unpersist()
    table = df.sparkSession.createDataFrame(found, "size double, train double, validation double")
    return table.groupBy("size").agg(
        F.avg("train").alias("train_mean"),
        F.stddev_pop("train").alias("train_std"),
        F.avg("validation").alias("validation_mean"),
        F.stddev_pop("validation").alias("validation_std"),
    )
