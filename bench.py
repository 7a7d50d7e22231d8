"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "profile_missing",
    "exact_percentiles",
    "robust_scale",
    "prepared_features",
    "iterative_impute",
    "mutual_information",
    "classification_report",
    "roc_auc_large",
    "regression_metrics",
    "rmse_by_quartile",
    "cluster_stats",
    "silhouette",
    "ks_drift",
    "drift_overall",
    "performance_trend",
    "degradation_check",
    "retention_last_n",
    "alert_cooldown_hot_key",
    "score_unseen",
    "stratified_folds",
    "ols_single",
    "train_classification_logistic_regression",
    "train_classification_gradient_boosting",
    "train_regression_random_forest",
    "train_classification_lda",
    "kmeans",
    "pca",
    "nearest_neighbours",
    "outliers",
    "stream_counters",
    "predict_pipeline",
]


def main() -> None:
    from modelyard.plans.catalog import Tables, load_all
    from modelyard.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = sys.argv[1:] or HEADLINES
    Tables(spark, folder).lineitem.groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        registry[name][0](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
