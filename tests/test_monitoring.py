import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.functions import text
from modelyard.operators import alerts, drift, history, performance, reports


def fx13(spark, shift=0.0):
    rng = np.random.default_rng(42)
    rows = [(float(a) + shift, float(b), "ABC"[i % 3]) for i, (a, b) in enumerate(zip(rng.normal(size=100), rng.normal(size=100)))]
    return spark.createDataFrame(rows, "feature1 double, feature2 double, feature3 string")


def test_drift_on_one_feature(spark):
    report = drift.drift_report(fx13(spark), fx13(spark, 2.0))
    found = {r["feature"]: r["drift_detected"] for r in report.collect()}
    assert found == {"feature1": True, "feature2": False, "feature3": False}
    overall = drift.overall_drift(report.select("feature", "drift_detected")).first()
    assert overall["drifted_features"] == ["feature1"] and overall["is_significant"] and overall["severity"] == "medium"
    status = {r["feature"]: r["status"] for r in reports.feature_status(report).collect()}
    assert status["feature1"] == "drift" and status["feature3"] == "stable"


@pytest.mark.parametrize("ranges", [2, 50])
def test_ks_statistic(spark, ranges):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(size=700), 1), np.round(rng.normal(0.2, 1, size=500), 1)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    got = drift.ks_test(drift.sides(ref, cur, ["x"]), ["x"], ranges=ranges).first()
    grid = np.unique(np.r_[a, b])
    gap = np.abs((a[:, None] <= grid).mean(axis=0) - (b[:, None] <= grid).mean(axis=0)).max()
    assert abs(got["statistic"] - gap) < 1e-12
    x = gap * np.sqrt(700 * 500 / 1200)
    want = 2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * x * x) for j in range(1, 101))
    assert abs(got["p_value"] - want) < 1e-12


def test_one_sided_categories(spark):
    ref = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "x string")
    cur = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "x string")
    got = drift.category_shift(drift.sides(ref, cur, ["x"]), ["x"]).first()
    assert abs(got["importance"] - 0.25) < 1e-12
    assert abs(got["importance_full"] - 0.25) < 1e-12
    stat = drift.chi_square(drift.sides(ref, cur, ["x"]), ["x"]).first()
    assert abs(stat["statistic"] - (1 / 3 + 1 / 3 + 1 + 1)) < 1e-12 and stat["dof"] == 3


def metric_rows(spark, values):
    start = dt.datetime(2024, 1, 10)
    rows = [("m", start - dt.timedelta(days=i), v) for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "model_id string, timestamp timestamp, value double")


def test_degradation(spark):
    past = metric_rows(spark, [0.80, 0.82])
    for value, want in ((0.85, "stable"), (0.60, "degraded")):
        now = spark.createDataFrame([("m", value)], "model_id string, value double")
        assert performance.check_performance(now, past).first()["status"] == want
    other = spark.createDataFrame([("n", 0.5)], "model_id string, value double")
    assert performance.check_performance(other, past).first()["status"] == "no_history"


def test_trend(spark):
    got = performance.trend(metric_rows(spark, [0.9, 0.5, 0.7])).first()
    assert got["direction"] == "improving"
    assert abs(got["volatility"] - np.std([-0.2, 0.4])) < 1e-12 and got["stability"] == "unstable"
    one = performance.trend(metric_rows(spark, [0.9])).first()
    assert (one["direction"], one["volatility"], one["stability"]) == ("unknown", 0.0, "stable")


def test_window_of_seven_days(spark):
    rows = metric_rows(spark, [0.8 + i / 100 for i in range(5)])
    assert performance.recent(rows, F.lit("2024-01-10").cast("timestamp"), 7, "m").count() == 5


def test_drift_summary(spark):
    days = [dt.datetime(2023, 1, 1 + i) for i in range(3)]
    rows = spark.createDataFrame(
        [(True, "f1", days[0]), (False, "f2", days[1]), (True, "f1", days[2])],
        "drift_detected boolean, feature_name string, detection_time timestamp",
    )
    got = history.drift_summary(rows).first()
    assert (got["total_checks"], got["drift_detected_count"], got["features_affected"]) == (3, 2, 1)


def test_improvement(spark):
    pairs = spark.createDataFrame([(0.8, 0.85), (0.0, 0.5), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = pairs.select(
        performance.improvement_percent(F.col("a"), F.col("b")), performance.improvement(F.col("a"), F.col("b"))
    ).collect()
    assert abs(got[0][0] - 6.25) < 1e-9
    assert got[1][0] == 0.0 and got[1][1] == float("inf") and got[2][1] == 0.0 and got[3][0] == 0.0


@pytest.mark.parametrize("span", [1, 3, 24])
def test_cooldown(spark, span):
    rng = np.random.default_rng(span)
    rows = []
    for key, n, width in (("hot", 900, 40_000), ("rare", 30, 400_000), ("burst", 200, 2000)):
        rows += [(key, int(s)) for s in rng.integers(0, width, n)]
    base = dt.datetime(2024, 1, 1)
    table = [(i, k, base + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(table, "id long, k string, ts timestamp").repartition(6)
    got = {r["id"] for r in alerts.cooldown(df, ["k"], "ts", "id", 600, span).where("passed").collect()}
    want, last = set(), {}
    for i, k, ts in sorted(table, key=lambda r: (r[2], r[0])):
        if k not in last or (ts - last[k]).total_seconds() >= 600:
            last[k] = ts
            want.add(i)
    assert got == want


def test_alert_key_leaves_the_time_out(spark):
    rows = spark.createDataFrame([("m", 0.5, dt.datetime(2024, 1, 1)), ("m", 0.5, dt.datetime(2024, 1, 2))], "model_id string, v double, ts timestamp")
    found = alerts.alert_rows(rows, F.col("v") < 1, "t", ["v", "model_id"], F.col("ts"), recipients=["a"])
    assert found.select("alert_key").distinct().count() == 1
    assert found.first()["data"] == '{"model_id":"m","v":"0.5"}'


def test_number_text(spark):
    values = [0.0, 1.0, 1234.0, -1234567.891, 1e15, 1e16, 1.5e22, 0.0001, 1.25e-7, 999999.999, 123.456]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.grouped_number(F.col("v"))).collect()] == ["{:,}".format(v) for v in values]
    words = spark.createDataFrame([("12345",), ("abc",), ("nan",)], "v string")
    assert [r[0] for r in words.select(text.grouped_number(F.col("v"))).collect()] == ["12,345.0", "abc", "nan"]


def test_duration_text(spark):
    df = spark.createDataFrame([(0,), (59,), (3600,), (90061,)], "s long")
    got = [r[0] for r in df.select(text.duration_text(F.col("s"))).collect()]
    assert got == ["0 ثانية", "59 ثانية", "1 ساعة", "1 يوم و 1 ساعة و 1 دقيقة و 1 ثانية"]


def test_interval_words(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(start, True, 0.1), (start + dt.timedelta(hours=5), False, 0.3)], "timestamp timestamp, success boolean, improvement double"
    )
    got = history.update_statistics(rows).first()
    assert got["update_frequency"] == "كل 5 ساعة" and got["successful_updates"] == 1
    assert history.update_statistics(rows.limit(1)).first()["update_frequency"] == "غير متوفر"


def test_page_and_documentation(spark):
    got = history.page(spark.range(23), [F.col("id")], 3, 10).collect()
    assert [r["id"] for r in got] == [20, 21, 22] and got[0]["total_pages"] == 3
    metrics = spark.createDataFrame([("accuracy", 0.85)], "metric string, value double")
    df = spark.createDataFrame([(1.0, "a", 1)], "feature1 double, feature3 string, target int")
    rows = {(r["section"], r["name"]) for r in reports.documentation(df, "target", metrics).collect()}
    assert {("feature", "feature1"), ("target", "target"), ("metric", "accuracy"), ("input", "feature3")} <= rows


def test_report_bundles(spark):
    info = spark.createDataFrame([("m", "active")], "model_id string, status string")
    metrics = spark.createDataFrame([("roc_auc", 0.9)], "metric string, value double")
    cells = spark.createDataFrame([(0, 0, 40), (0, 1, 10), (1, 0, 5), (1, 1, 45)], "label int, prediction int, n long")
    rows = reports.model_report(info, metrics, cells, metrics, metrics)
    assert rows.where("section = 'confusion'").count() == 4
    assert '"label":"ROC AUC"' in rows.where("section = 'metrics'").first()["item"]
    perf = spark.createDataFrame([(0.85, 0.82)], "current double, baseline double")
    out = reports.monitoring_report(info, perf, metrics, metrics).where("section = 'performance'").first()["item"]
    assert '"change":0.03' in out


def test_empty_side_and_single_class(spark):
    from modelyard.operators.classification import roc_auc, roc_curve
    from modelyard.operators.clustering import silhouette

    full = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    report = drift.drift_report(full, full.limit(0)).collect()
    assert len(report) == 3 and not any(r["drift_detected"] for r in report)
    scores = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert roc_auc(scores, F.col("y") == 1, F.col("s")).first()[0] is None
    assert roc_curve(scores, F.col("y") == 1, F.col("s")).count() == 3
    same = spark.createDataFrame([(i, [1.0], i % 2) for i in range(4)], "k long, v array<double>, c int")
    assert silhouette(same, "v", "c", "k").first()[0] == 0.0
