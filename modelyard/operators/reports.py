"""The tables behind reports and dashboards."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard.functions.text import capitalise, display_label
from modelyard.functions.values import row_json
from modelyard.operators.drift import bin_number
from modelyard.operators.history import latest_per_key

# Metrics of the performance chart.
CHART_METRICS = ("accuracy", "precision", "recall", "f1")


def metric_points(metrics: DataFrame, names: Sequence[str] = CHART_METRICS) -> DataFrame:
    """(model_id, timestamp, metric, label, value) rows of the metrics that are present."""
    long = metrics.select("model_id", "timestamp", F.explode("metrics").alias("metric", "value"))
    return long.where(F.col("metric").isin(*names)).withColumn("label", capitalise(F.col("metric")))


def prediction_counts(df: DataFrame, time: str, unit: str = "day", group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, F.date_trunc(unit, F.col(time)).alias("period")).agg(F.count("*").alias("n"))


def drift_heatmap(drift: DataFrame, times: Sequence, time: str = "detection_time", tie: str = "id") -> DataFrame:
    """Feature by detection time: the first score, 0 where there is none. The times are listed, so one pass is enough."""
    first = F.min_by("drift_score", tie)
    wide = drift.groupBy("feature_name").pivot(time, list(times)).agg(first)
    return wide.fillna(0.0)


def histogram(df: DataFrame, column: str, bins: int = 30, group: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin over the whole range, with the bin edges."""
    value = F.col(column).cast("double")
    value = F.when(~F.isnan(value), value)
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, lower double, upper double")
    width = (hi - lo) / bins
    counts = df.where(value.isNotNull()).groupBy(*group, bin_number(value, lo, hi, bins).alias("bin")).agg(
        F.count("*").alias("n")
    )
    return counts.withColumns(
        {"lower": F.lit(lo) + F.col("bin") * F.lit(width), "upper": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)}
    )


def prediction_histogram(df: DataFrame, prediction: str, actual: str | None = None, bins: int = 30) -> DataFrame:
    """Counts per side and bin over the shared range of predictions and, when given, actual values."""
    entries = [F.struct(F.lit("prediction").alias("side"), F.col(prediction).cast("double").alias("value"))]
    if actual:
        entries.append(F.struct(F.lit("actual").alias("side"), F.col(actual).cast("double").alias("value")))
    return histogram(df.select(F.inline(F.array(*entries))), "value", bins, ["side"])


def distributions(both: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Reference and current counts per shared bin; `both` comes from `drift.sides`."""
    named = both.withColumn("side", F.when(F.col("is_current"), "current").otherwise("reference"))
    return histogram(named, column, bins, ["side"])


def top_features(importance: DataFrame, n: int = 15, name: str = "feature_name", score: str = "importance_score") -> DataFrame:
    return importance.orderBy(F.col(score).desc(), name).limit(n)


def error_distribution(metrics: DataFrame, group: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """The entries of the map column of the newest row per group."""
    return latest_per_key(metrics, order, group).select(*group, F.explode(column).alias("name", "value"))


def section(df: DataFrame, name: str) -> DataFrame:
    """Any table as (section, item) rows of JSON, to put different tables in one report."""
    return df.select(F.lit(name).alias("section"), row_json(df.columns).alias("item"))


def bundle(sections: dict[str, DataFrame]) -> DataFrame:
    """A report as one long table."""
    out = None
    for name, df in sections.items():
        part = section(df, name)
        out = part if out is None else out.unionByName(part)
    return out


def model_report(
    info: DataFrame, metrics: DataFrame, confusion: DataFrame, importance: DataFrame, history: DataFrame
) -> DataFrame:
    """Info, labelled metrics, confusion cells, importance and history of a model."""
    labelled = metrics.withColumn("label", display_label(F.col("metric")))
    return bundle(
        {"info": info, "metrics": labelled, "confusion": confusion, "importance": importance, "history": history}
    )


def monitoring_report(alerts: DataFrame, performance: DataFrame, drift: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alerts, performance with its change against the baseline, drift and prediction totals."""
    changed = performance.withColumn("change", F.col("current") - F.col("baseline"))
    return bundle({"alerts": alerts, "performance": changed, "drift": drift, "predictions": predictions})


def feature_status(report: DataFrame) -> DataFrame:
    """One row per feature of a drift report: scores side by side and the status."""
    names = ["ks_test", "js_divergence", "chi_square"]
    picked = [F.max(F.when(F.col("test") == n, F.col("statistic"))).alias(n) for n in names]
    return report.groupBy("feature").agg(
        *picked,
        F.min("p_value").alias("p_value"),
        F.first("importance").alias("importance"),
        F.when(F.bool_or("drift_detected"), "drift").otherwise("stable").alias("status"),
    )


def report_list(
    reports: DataFrame, kind: str | None = None, model_id: str | None = None, day: Column | None = None
) -> DataFrame:
    """Reports by type, model and day, newest first."""
    if kind is not None:
        reports = reports.where(F.col("report_type") == kind)
    if model_id is not None:
        reports = reports.where(F.col("model_id") == model_id)
    if day is not None:
        reports = reports.where(F.col("created_at").cast("date") == day.cast("date"))
    return reports.orderBy(F.col("created_at").desc(), "report_id")


def documentation(df: DataFrame, target: str, metrics: DataFrame) -> DataFrame:
    """Model documentation rows: every feature with its type and role, the target, the metrics and both formats."""
    from modelyard.operators.profile import column_roles

    roles = column_roles(df, target)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [("feature", c, f"{role} {kinds[c]}") for role in ("numeric", "categorical") for c in roles[role]]
    rows += [("target", target, kinds[target]), ("output", "prediction", "double")]
    rows += [("input", c, kinds[c]) for role in ("numeric", "categorical") for c in roles[role]]
    fixed = df.sparkSession.createDataFrame(rows, "section string, name string, detail string")
    return fixed.unionByName(
        metrics.select(F.lit("metric").alias("section"), F.col("metric").alias("name"), F.col("value").cast("string").alias("detail"))
    )
