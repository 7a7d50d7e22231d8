"""Whole jobs: train, predict, monitor, retrain. Each writes what happened to the store."""

import json
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from modelyard import settings
from modelyard.operators import alerts as A
from modelyard.operators import drift as D
from modelyard.operators import performance as P
from modelyard.operators.classification import classification_metrics, roc_auc
from modelyard.operators.clustering import evaluate_clustering
from modelyard.operators.explain import feature_importance
from modelyard.operators.prepare import Prepared, fit_preparation
from modelyard.operators.regression import evaluate_regression
from modelyard.operators.scoring import coerce, prediction_rows
from modelyard.operators.search import search, trial_table
from modelyard.operators.split import train_test_split
from modelyard.sources.store import Store, prediction_log


def evaluate(model, df: DataFrame, task: str, key: str | None = None, shape: str = "silhouette") -> DataFrame:
    """(metric, value) rows of a model on a prepared table; `shape` names the silhouette of clusters. An unknown task is an error."""
    if task not in settings.TASKS:
        raise ValueError(f"unknown task {task}")
    if task == "dimensionality_reduction":
        from modelyard.operators.search import score

        return df.sparkSession.createDataFrame([("variance_kept", float(score(model, df, task)))], "metric string, value double")
    scored = model.transform(df)
    wanted = [c for c in ("label", "prediction", "probability") if c in scored.columns]
    if task == "clustering":
        wanted += ["features", key]
    # The rows are scored once; the metrics are a handful of numbers.
    scored = scored.select(*wanted).persist()
    try:
        metrics = _metrics(scored, task, key, shape)
        return df.sparkSession.createDataFrame([tuple(r) for r in metrics.collect()], metrics.schema)
    finally:
        scored.unpersist()


def envelope(metrics: DataFrame, rows: DataFrame, features: Sequence[str], task: str, now: Column) -> DataFrame:
    """Metric rows with the task, the number of rows and features, and the time of the evaluation."""
    return metrics.withColumns(
        {
            "task_type": F.lit(task),
            "n_samples": rows.agg(F.count("*")).scalar(),
            "n_features": F.lit(len(features)),
            "timestamp": now.cast("timestamp"),
        }
    )


def _metrics(scored: DataFrame, task: str, key: str | None, shape: str) -> DataFrame:
    if task == "regression":
        return evaluate_regression(scored, "label", "prediction")
    if task == "clustering":
        return evaluate_clustering(scored, "features", "prediction", key, shape)
    metrics = classification_metrics(scored, "label", "prediction")
    if "probability" in scored.columns and scored.agg(F.max("label")).first()[0] == 1.0:
        area = roc_auc(scored, F.col("label") == 1, vector_to_array("probability")[1])
        metrics = metrics.unionByName(area.select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
    return metrics


def _as_map(metrics: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in metrics.collect() if r["value"] is not None}


def train(
    store: Store,
    df: DataFrame,
    target: str | None,
    task: str,
    model_id: str,
    key: Sequence[str],
    now: Column,
    version: str = "1",
    preparation: dict | None = None,
    **search_options,
) -> dict:
    """Hold out a test share, prepare on the training share, search, evaluate on the held-out rows, save everything."""
    spark = df.sparkSession
    train_rows, test_rows = train_test_split(df, key)
    prepared = fit_preparation(train_rows, target, task, ignore=key, **(preparation or {}))
    table = prepared.transform(train_rows, keep=key)
    found = search(table, task, key, **search_options)
    held = prepared.transform(test_rows, keep=key)
    metrics = evaluate(found["model"], held, task, key[0])
    values = _as_map(metrics)
    store.save_model(
        found["model"],
        model_id,
        {
            "task_type": task,
            "target_column": target,
            "version": version,
            "preparation": prepared.to_json(),
            "parameters": found["best"]["params"],
            "model": found["best"]["model"],
        },
        now,
    )
    size = held.count()
    row = spark.createDataFrame([(model_id, values, size)], "model_id string, metrics map<string,double>, dataset_size long")
    store.append("model_metrics", row.withColumn("timestamp", now))
    names = prepared.feature_names
    importance = feature_importance(spark, found["model"], names).withColumns(
        {"model_id": F.lit(model_id), "importance_type": F.lit("model"), "timestamp": now}
    )
    store.append("feature_importance", importance)
    job = spark.range(1).select(
        F.lit(model_id).alias("model_id"),
        now.alias("start_time"),
        now.alias("end_time"),
        F.lit("completed").alias("status"),
        F.lit(json.dumps(found["best"]["params"])).alias("training_params"),
    )
    store.append("training_jobs", job)
    return {
        "model": found["model"],
        "prepared": prepared,
        "metrics": values,
        "trials": trial_table(spark, found["trials"]),
        "best": found["best"],
    }


def predict(store: Store, df: DataFrame, model_id: str, now: Column, keep: Sequence[str] = (), log: bool = True) -> DataFrame:
    """Check, coerce and score rows with a stored model, and append them to the prediction log."""
    model, document = store.load_model(model_id)
    prepared = Prepared.from_json(document["preparation"])
    inputs = [*prepared.numeric, *prepared.categorical]
    rows = coerce(df, inputs)
    scored = model.transform(prepared.transform(rows, keep=[*keep, *[c for c in inputs if c not in keep]]))
    out = prediction_rows(scored, now, document["model"], document["version"], keep=[*keep, *[c for c in inputs if c not in keep]])
    if log:
        store.append("predictions", prediction_log(out, model_id, inputs))
    return out.drop(*[c for c in inputs if c not in keep])


def monitor(
    store: Store,
    reference: DataFrame,
    current: DataFrame,
    model_id: str,
    current_metrics: dict[str, float],
    now: Column,
    recipients: Sequence[str] = (),
    min_rows: int = settings.MIN_DRIFT_ROWS,
) -> dict:
    """Drift when there are enough rows, performance against the stored history, alerts, all appended to the store."""
    spark = reference.sparkSession
    out: dict = {"drift": None, "overall": None}
    if current.limit(min_rows).count() >= min_rows:
        report = D.drift_report(reference, current).persist()
        overall = D.overall_drift(report.select("feature", "drift_detected"))
        store.append("data_drift", D.drift_rows(report, model_id, now))
        alert = overall.withColumn("model_id", F.lit(model_id)).withColumn("ratio", F.round("drift_ratio", 6))
        rows = A.alert_rows(
            alert, F.col("is_significant"), "data_drift_alert", ["model_id", "ratio"], now, F.col("severity"), recipients
        )
        store.append("alerts", rows)
        out |= {"drift": report, "overall": overall}
    history = P.recent(P.metric_series(store.read("model_metrics")), now, model_id=model_id)
    value = current_metrics.get("accuracy", current_metrics.get("r2", 0.0))
    now_row = spark.createDataFrame([(model_id, float(value))], "model_id string, value double")
    performance = P.check_performance(now_row, history)
    rows = A.alert_rows(
        performance,
        F.col("status") == "degraded",
        "model_performance_alert",
        ["model_id", "current", "threshold"],
        now,
        F.lit("high"),
        recipients,
    )
    store.append("alerts", rows)
    out["performance"] = performance
    return out


def retrain_if_better(
    store: Store,
    df: DataFrame,
    model_id: str,
    key: Sequence[str],
    now: Column,
    threshold: float = settings.IMPROVEMENT_THRESHOLD,
    **search_options,
) -> dict:
    """Champion against challenger on held-out new rows; the challenger is stored when it is clearly better."""
    spark = df.sparkSession
    champion, document = store.load_model(model_id)
    task, target = document["task_type"], document["target_column"]
    old = Prepared.from_json(document["preparation"])
    train_rows, test_rows = train_test_split(df, key)
    before = _as_map(evaluate(champion, old.transform(test_rows, keep=key), task, key[0]))
    prepared = fit_preparation(train_rows, target, task, ignore=key)
    found = search(prepared.transform(train_rows, keep=key), task, key, **search_options)
    after = _as_map(evaluate(found["model"], prepared.transform(test_rows, keep=key), task, key[0]))
    name = "accuracy" if task == "classification" else "r2"
    change = spark.range(1).select(P.improvement(F.lit(before.get(name, 0.0)), F.lit(after.get(name, 0.0)))).first()[0]
    better = change > threshold
    if better:
        version = str(int(document.get("version", "1")) + 1)
        info = {
            "task_type": task,
            "target_column": target,
            "version": version,
            "preparation": prepared.to_json(),
            "parameters": found["best"]["params"],
            "model": found["best"]["model"],
        }
        store.save_model(found["model"], model_id, info, now)
    row = spark.createDataFrame(
        [(model_id, "retrain", before, after, bool(better))],
        "model_id string, update_type string, performance_before map<string,double>, "
        "performance_after map<string,double>, success boolean",
    )
    store.append("model_updates", row.withColumn("update_time", now))
    return {"improvement": change, "updated": better, "before": before, "after": after, "negative_base": before.get(name, 0.0) < 0}
