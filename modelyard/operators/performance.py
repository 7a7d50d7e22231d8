"""Metric histories: trend, statistics, degradation and health. A history has model_id, timestamp and a value."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard import settings
from modelyard.functions.text import matches_search
from modelyard.functions.values import pick_metric
from modelyard.operators.ordered import with_previous


def metric_series(metrics: DataFrame, *names: str) -> DataFrame:
    """(model_id, timestamp, value) from a map column `metrics`: accuracy, else r2, else 0."""
    return metrics.select("model_id", "timestamp", pick_metric(F.col("metrics"), *names).alias("value"))


def recent(history: DataFrame, now: Column, days: int = settings.HISTORY_DAYS, model_id: str | None = None) -> DataFrame:
    """Rows of the last `days` days before `now`."""
    kept = history.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return kept if model_id is None else kept.where(F.col("model_id") == model_id)


def between(history: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows from `start` to `end`, both included, both optional."""
    if start is not None:
        history = history.where(F.col("timestamp") >= start)
    if end is not None:
        history = history.where(F.col("timestamp") <= end)
    return history


def differences(history: DataFrame, group: Sequence[str] = ("model_id",), tie: Sequence[str] = ()) -> DataFrame:
    """Add `change`, the step from the row before in time."""
    stepped = with_previous(history, ["value"], "timestamp", group, tie)
    return stepped.withColumn("change", F.col("value") - F.col("prev_value")).drop("prev_value")


def trend(history: DataFrame, group: Sequence[str] = ("model_id",), tie: Sequence[str] = ()) -> DataFrame:
    """Direction, volatility (population deviation of the steps) and stability of every series.

    With fewer than two points the direction is `unknown` and the volatility 0.
    """
    steps = differences(history, group, tie)
    row = steps.groupBy(*group).agg(
        F.avg("change").alias("mean_change"), F.coalesce(F.stddev_pop("change"), F.lit(0.0)).alias("volatility")
    )
    return row.select(
        *group,
        F.when(F.col("mean_change").isNull(), "unknown")
        .when(F.col("mean_change") > 0, "improving")
        .otherwise("degrading")
        .alias("direction"),
        "volatility",
        F.when(F.col("volatility") < 0.1, "stable").otherwise("unstable").alias("stability"),
    )


def statistics(history: DataFrame, group: Sequence[str] = ("model_id",)) -> DataFrame:
    """Mean, deviation, minimum and maximum of every series."""
    value = F.col("value")
    return history.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def check_performance(
    current: DataFrame,
    history: DataFrame,
    ratio: float = settings.PERFORMANCE_RATIO,
    group: Sequence[str] = ("model_id",),
) -> DataFrame:
    """`degraded` when the current value is below `ratio` times the mean of the history; `no_history` without one.

    `current` has one (group, value) row per series.
    """
    past = statistics(history, group).select(*group, F.col("mean").alias("baseline"))
    joined = current.select(*group, F.col("value").alias("current")).join(past, list(group), "left")
    joined = joined.join(trend(history, group), list(group), "left")
    limit = F.col("baseline") * ratio
    return joined.select(
        *group,
        "current",
        "baseline",
        limit.alias("threshold"),
        F.when(F.col("baseline").isNull(), "no_history")
        .when(F.col("current") < limit, "degraded")
        .otherwise("stable")
        .alias("status"),
        "direction",
        "volatility",
        "stability",
    )


def metric_summary(metrics: DataFrame, group: Sequence[str] = ("model_id",)) -> DataFrame:
    """Per metric name of the map column: current value, mean, deviation and slope per day."""
    long = metrics.select(*group, "timestamp", F.explode("metrics").alias("metric", "value"))
    day = F.unix_micros("timestamp") / 86400e6
    return long.groupBy(*group, "metric").agg(
        F.max_by("value", "timestamp").alias("current"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.regr_slope("value", day).alias("trend"),
    )


def health(performance: DataFrame, drift: DataFrame) -> DataFrame:
    """`critical` when degraded or drift is severe, `warning` on significant drift, else `healthy` (our rule).

    `performance` has (model_id, status), `drift` has (model_id, is_significant, severity).
    """
    joined = performance.select("model_id", "status").join(
        drift.select("model_id", "is_significant", "severity"), "model_id", "full_outer"
    )
    critical = (F.col("status") == "degraded") | (F.col("severity") == "high")
    return joined.select(
        "model_id",
        F.when(critical, "critical").when(F.col("is_significant"), "warning").otherwise("healthy").alias("health"),
    )


def health_list(checked: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Models by health status and text, worst first."""
    if status is not None:
        checked = checked.where(F.col("health") == status)
    if search:
        checked = checked.where(matches_search(search, F.col("model_id")))
    order = F.when(F.col("health") == "critical", 0).when(F.col("health") == "warning", 1).otherwise(2)
    return checked.orderBy(order, "model_id")


def improvement(before: Column, after: Column) -> Column:
    """Relative change; from 0 it is infinite for a gain, else 0. A negative start turns the sign (see `negative_base`)."""
    return F.when(before == 0, F.when(after > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((after - before) / before)


def improvement_percent(before: Column, after: Column) -> Column:
    """Relative change in percent; 0 when the start is missing or 0."""
    return F.when(before.isNull() | (before == 0) | after.isNull(), 0.0).otherwise((after - before) / before * 100)
