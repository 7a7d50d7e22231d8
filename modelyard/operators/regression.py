"""Regression metrics from a table with a label and a prediction."""

from pyspark.sql import DataFrame, functions as F

from modelyard.functions.stats import corrected_kurtosis, corrected_skewness
from modelyard.operators.classification import long_metrics
from modelyard.operators.ordered import exact_percentiles

# Fixed value: smallest denominator of a relative error (double machine epsilon).
RELATIVE_FLOOR = 2.220446049250313e-16

METRICS = ["mse", "rmse", "mae", "r2", "explained_variance", "max_error", "mape"]
RESIDUALS = ["residual_mean", "residual_std", "residual_skew", "residual_kurtosis"]


def _errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.select(y.alias("y"), (y - p).alias("e")).where("y IS NOT NULL AND e IS NOT NULL")


def _one_row(errors: DataFrame) -> DataFrame:
    e, y = F.col("e"), F.col("y")
    square = F.avg(e * e)
    spread = F.var_pop(y)
    return errors.agg(
        square.alias("mse"),
        F.sqrt(square).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - square / spread).when(square == 0, 1.0).otherwise(0.0).alias("r2"),
        F.when(spread > 0, 1 - F.var_pop(e) / spread)
        .when(F.var_pop(e) == 0, 1.0)
        .otherwise(0.0)
        .alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(RELATIVE_FLOOR))).alias("mape"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
        corrected_skewness(e).alias("residual_skew"),
        corrected_kurtosis(e).alias("residual_kurtosis"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Seven error measures as (metric, value) rows, one pass."""
    return long_metrics(_one_row(_errors(df, label, prediction)), METRICS)


def residual_stats(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean, population deviation and bias-corrected skewness and kurtosis of label minus prediction."""
    return long_metrics(_one_row(_errors(df, label, prediction)), RESIDUALS)


def rmse_by_quartile(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """RMSE per label range `(lower, upper]` cut at the exact quartiles; empty ranges are absent."""
    errors = _errors(df, label, prediction)
    first, second, third = exact_percentiles(errors, ["y"], [0.25, 0.5, 0.75])["y"]
    if first is None:
        raise ValueError("the table is empty")
    y = F.col("y")
    piece = F.when(y <= first, 1).when(y <= second, 2).when(y <= third, 3).otherwise(4)
    return (
        errors.groupBy(piece.alias("piece"))
        .agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("value"), F.count("*").alias("n"))
        .select(F.concat(F.lit("rmse_range_"), F.col("piece").cast("string")).alias("metric"), "value", "n")
    )


def evaluate_regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All regression metrics in one long table."""
    errors = _one_row(_errors(df, label, prediction))
    return long_metrics(errors, METRICS + RESIDUALS).unionByName(
        rmse_by_quartile(df, label, prediction).drop("n")
    )
