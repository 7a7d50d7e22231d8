"""Newest rows, retention, filters, pages, derived columns and summary rows over history tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from modelyard.functions.text import interval_text, matches_search
from modelyard.operators.ordered import exact_percentiles, with_previous


def newest(df: DataFrame, n: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The newest `n` rows per group by `order`.

    Up to the window group limit threshold Spark keeps only `n` rows per key on the map side, so a hot key is cut
    before the shuffle. Without a group it is a distributed top-n.
    """
    latest_first = [F.col(c).desc() for c in order]
    if not group:
        return df.orderBy(*latest_first).limit(n)
    window = Window.partitionBy(*group).orderBy(*latest_first)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, order: Sequence[str], group: Sequence[str]) -> DataFrame:
    """The newest row per group, as a map-side aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in group]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(row).select(*group, "_row.*")


def comparison_windows(
    df: DataFrame, order: Sequence[str], group: Sequence[str], current: int, reference: int
) -> DataFrame:
    """The newest `current` rows per group tagged `current`, the `reference` rows before them tagged `reference`."""
    window = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= current + reference)
    side = F.when(F.col("_rank") <= current, "current").otherwise("reference")
    return ranked.withColumn("side", side).drop("_rank")


def registry_list(
    models: DataFrame,
    status: str | None = None,
    task_type: str | None = None,
    search: str | None = None,
    sort_by: str = "creation_date",
    descending: bool = True,
) -> DataFrame:
    """Models by status, task type and text, sorted by any column."""
    if status is not None:
        models = models.where(F.col("status") == status)
    if task_type is not None:
        models = models.where(F.col("task_type") == task_type)
    if search:
        models = models.where(matches_search(search, F.col("model_id"), F.col("task_type")))
    return models.orderBy(F.col(sort_by).desc() if descending else F.col(sort_by).asc(), "model_id")


def prediction_list(
    predictions: DataFrame, model_id: str | None = None, day: Column | None = None, search: str | None = None
) -> DataFrame:
    """Predictions by model, day and text."""
    if model_id is not None:
        predictions = predictions.where(F.col("model_id") == model_id)
    if day is not None:
        start = day.cast("date").cast("timestamp")
        predictions = predictions.where(
            (F.col("prediction_time") >= start) & (F.col("prediction_time") < start + F.expr("INTERVAL 1 DAY"))
        )
    if search:
        predictions = predictions.where(matches_search(search, F.col("model_id"), F.col("prediction").cast("string")))
    return predictions


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows, with the total row and page counts."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"total_rows": total, "total_pages": F.ceil(total / F.lit(size))})


def with_age(models: DataFrame, now: Column) -> DataFrame:
    return models.withColumn("age_days", F.floor((F.unix_micros(now) - F.unix_micros("creation_date")) / 86400e6).cast("int"))


def with_correctness(predictions: DataFrame) -> DataFrame:
    """`is_correct`, NULL while the actual value is unknown."""
    known = F.col("actual_value").isNotNull()
    return predictions.withColumn("is_correct", F.when(known, F.col("prediction") == F.col("actual_value")))


def with_duration(jobs: DataFrame) -> DataFrame:
    """`duration_seconds`, 0 while a job runs."""
    span = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    return jobs.withColumn("duration_seconds", F.coalesce(span, F.lit(0.0)))


def prediction_stats(df: DataFrame, prediction: str, time: str, exact_distinct: bool = True) -> DataFrame:
    """Total, distinct predictions and the last time."""
    distinct = F.count_distinct(prediction) if exact_distinct else F.approx_count_distinct(prediction)
    return df.agg(
        F.count("*").alias("total_predictions"),
        distinct.alias("unique_predictions"),
        F.max(time).alias("last_prediction_time"),
    )


def service_rates(df: DataFrame, status: str | None, response_time: str | None, group: Sequence[str] = ()) -> DataFrame:
    """Mean response time, success rate and error rate; 1 and 0 when there is no status column."""

    def rate(value: str, absent: float) -> Column:
        if status is None or status not in df.columns:
            return F.lit(absent)
        return F.avg((F.col(status) == value).cast("double"))

    speed = F.avg(response_time) if response_time in df.columns else F.lit(None).cast("double")
    return df.groupBy(*group).agg(
        F.count("*").alias("n"),
        speed.alias("average_response_time"),
        F.coalesce(rate("success", 1.0), F.lit(0.0)).alias("success_rate"),
        F.coalesce(rate("error", 0.0), F.lit(0.0)).alias("error_rate"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum as (metric, value) rows."""
    quarters = exact_percentiles(df, [column], [0.25, 0.5, 0.75])[column]
    value = F.col(column).cast("double")
    row = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    cells = [("count", F.col("count")), ("mean", F.col("mean")), ("std", F.col("std")), ("min", F.col("min"))]
    cells += [(n, F.lit(q).cast("double")) for n, q in zip(("25%", "50%", "75%"), quarters)]
    cells.append(("max", F.col("max")))
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in cells]))
    )


def update_statistics(updates: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Total, successful, mean improvement, last update and the mean interval in words.

    `updates` has timestamp, success and improvement. The mean of the intervals is (last - first) / (n - 1).
    """
    n = F.count("*")
    seconds = (F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 1e6
    row = updates.groupBy(*group).agg(
        n.alias("total_updates"),
        F.count(F.when(F.col("success"), 1)).alias("successful_updates"),
        F.avg("improvement").alias("average_improvement"),
        F.max("timestamp").alias("last_update"),
        F.when(n > 1, seconds / (n - 1)).alias("mean_interval_seconds"),
    )
    return row.withColumn("update_frequency", interval_text(F.col("mean_interval_seconds")))


def intervals(df: DataFrame, time: str, group: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Add `interval_seconds` since the row before in the same group."""
    stepped = with_previous(df, [time], time, group, tie)
    gap = (F.unix_micros(time) - F.unix_micros(f"prev_{time}")) / 1e6
    return stepped.withColumn("interval_seconds", gap).drop(f"prev_{time}")


def drift_summary(drift: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Checks, detections, distinct affected features and the last detection time."""
    hit = F.col("drift_detected")
    return drift.groupBy(*group).agg(
        F.count("*").alias("total_checks"),
        F.count(F.when(hit, 1)).alias("drift_detected_count"),
        F.count_distinct(F.when(hit, F.col("feature_name"))).alias("features_affected"),
        F.max("detection_time").alias("last_detection"),
    )


def monitoring_summary(checks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Checks, how often drift was significant, how often performance was degraded, and the last check.

    `checks` has timestamp, is_significant and status.
    """
    return checks.groupBy(*group).agg(
        F.count("*").alias("total_checks"),
        F.avg(F.coalesce(F.col("is_significant"), F.lit(False)).cast("double")).alias("drift_frequency"),
        F.avg(F.coalesce(F.col("status") == "degraded", F.lit(False)).cast("double")).alias(
            "performance_degradation_frequency"
        ),
        F.max("timestamp").alias("last_check"),
    )


def most_drifted(checks: DataFrame, top: int = 5) -> DataFrame:
    """The features found drifted most often; `checks` has an array column `drifted_features`, one row per check."""
    total = checks.agg(F.count("*")).scalar()
    return (
        checks.select(F.explode("drifted_features").alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "feature")
        .limit(top)
        .select("feature", (F.col("n") / total).alias("drift_frequency"))
    )


def model_overview(models: DataFrame) -> DataFrame:
    """Models per task type, with the total."""
    counts = models.groupBy("task_type").agg(F.count("*").alias("n"))
    return counts.withColumn("total_models", counts.agg(F.sum("n")).scalar())


def recent_updates(updates: DataFrame, before: str, after: str, n: int = 5) -> DataFrame:
    """The newest updates with their change in percent."""
    from modelyard.operators.performance import improvement_percent

    return newest(updates, n, ["timestamp", "model_id"]).withColumn(
        "improvement", improvement_percent(F.col(before), F.col(after))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table, as one job."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def monitoring_header(models: DataFrame, predictions: DataFrame, metrics: DataFrame, drift: DataFrame) -> DataFrame:
    """Active models, predictions, mean performance in percent and drift alerts, as one row of scalar subqueries.

    `metrics` has a column `value`.
    """
    active = models.where(F.col("status") == "active").agg(F.count("*").alias("active_models"))
    return active.select(
        "active_models",
        predictions.agg(F.count("*")).scalar().alias("total_predictions"),
        metrics.agg(F.avg("value") * 100).scalar().alias("mean_performance"),
        drift.where("drift_detected").agg(F.count("*")).scalar().alias("drift_alerts"),
    )
