import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from modelyard.functions.values import fingerprint, table_digest
from modelyard.operators.models import estimator
from modelyard.operators.scoring import coerce, prediction_rows, score_with_cache
from modelyard.plans.pipelines import monitor, predict, retrain_if_better, train
from modelyard.sources import readers
from modelyard.sources.store import Store, read_model, write_model
from modelyard.streaming import jobs


def now():
    return F.lit("2024-03-01").cast("timestamp")


def later():
    return F.lit("2024-03-02").cast("timestamp")



def people(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, c = float(rng.normal()), "xyz"[int(rng.integers(0, 3))]
        b = None if rng.random() < 0.1 else float(rng.normal())
        rows.append((i, a, b, c, "yes" if a + (c == "x") > 0.4 else "no"))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y string")


def test_train_predict_retrain_delete(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = people(spark)
    options = {"n_trials": 2, "folds": 2, "names": ["lda", "decision_tree"]}
    out = train(store, df, "y", "classification", "m", ["id"], now(), **options)
    assert out["metrics"]["accuracy"] > 0.8
    scored = predict(store, df.drop("y"), "m", now(), keep=["id"]).collect()
    assert len(scored) == 400 and set(scored[0]["probabilities"]) == {"class_0", "class_1"}
    assert store.read("predictions").where("pred_date = '20240301'").count() == 400
    assert store.read("feature_importance").count() == len(out["prepared"].feature_names)
    found = retrain_if_better(store, people(spark, seed=1), "m", ["id"], later(), threshold=5.0, **options)
    assert not found["updated"] and store.read("model_updates").count() == 1
    assert store.update_model("m", {"description": "better words", "note": 1}, later())
    info = store.model_info("m").first()
    assert info["description"] == "better words" and '"note": 1' in info["model_info"]
    assert store.versions("m").count() == 2 and "spark_version" in store.dependencies("m")
    store.export_model("m", f"{tmp_path}/out")
    store.import_model(f"{tmp_path}/out", "copy", later())
    assert {r["model_id"] for r in store.models().collect()} == {"m", "copy"}
    store.delete_model("m")
    assert {r["model_id"] for r in store.models().collect()} == {"copy"}
    assert store.read("predictions").isEmpty() and store.read("model_metrics").isEmpty()
    assert not store.update_model("m", {}, later())


def test_changed_files_are_noticed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    model = estimator("pca", "dimensionality_reduction").fit(
        spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([2.0, 1.0]),)], ["features"])
    )
    path = store.save_model(model, "p", {"task_type": "dimensionality_reduction"}, now())
    store.load_model("p")
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"{path}/model")
    with pytest.raises(ValueError):
        store.load_model("p")


@pytest.mark.parametrize(
    "name, task",
    [
        ("logistic_regression", "classification"),
        ("ada_boost", "classification"),
        ("knn", "classification"),
        ("ridge", "classification"),
        ("gradient_boosting", "regression"),
        ("kmeans", "clustering"),
        ("minibatch_kmeans", "clustering"),
        ("nmf", "dimensionality_reduction"),
    ],
)
def test_models_survive_the_disk(spark, tmp_path, name, task):
    rng = np.random.default_rng(0)
    rows = [(i, Vectors.dense(rng.uniform(size=2)), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, ["key", "features", "label"])
    small = {"ada_boost": {"n_estimators": 2}, "gradient_boosting": {"n_estimators": 2}, "kmeans": {"n_clusters": 2}}
    model = estimator(name, task, **small.get(name, {})).fit(df)
    write_model(spark, model, f"{tmp_path}/m")
    again = read_model(spark, f"{tmp_path}/m")
    column = "reduced" if task == "dimensionality_reduction" else "prediction"

    def values(m):
        return [tuple(np.atleast_1d(r[column].toArray() if column == "reduced" else r[column])) for r in m.transform(df).orderBy("key").collect()]

    assert values(again) == values(model)


def test_monitor(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    past = spark.createDataFrame(
        [("m", dt.datetime(2024, 2, 20), {"accuracy": 0.8}), ("m", dt.datetime(2024, 2, 21), {"accuracy": 0.82})],
        "model_id string, timestamp timestamp, metrics map<string,double>",
    )
    store.append("model_metrics", past)
    ref = people(spark, 1200).drop("id")
    cur = ref.withColumn("a", F.col("a") + 3).withColumn("b", F.col("b") * 4)
    out = monitor(store, ref, cur, "m", {"accuracy": 0.5}, now(), ["ops"])
    assert out["performance"].first()["status"] == "degraded"
    assert store.read("data_drift").where("drift_detected").count() >= 2
    assert {r["template"] for r in store.read("alerts").collect()} == {"data_drift_alert", "model_performance_alert"}
    few = monitor(store, ref, cur.limit(10), "m", {"accuracy": 0.81}, now())
    assert few["drift"] is None and few["performance"].first()["status"] == "stable"


def test_cache_age(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    keys = df.select(fingerprint(["x"]).alias("fingerprint"), F.lit(9.0).alias("prediction"))
    calls = lambda rows: rows.withColumn("prediction", F.col("x"))
    fresh = keys.withColumn("scored_at", now() - F.expr("INTERVAL 10 MINUTES"))
    old = keys.withColumn("scored_at", now() - F.expr("INTERVAL 2 HOURS"))
    assert score_with_cache(df, ["x"], fresh, calls, now()).where("cached").count() == 2
    got = score_with_cache(df, ["x"], old, calls, now()).collect()
    assert [r["prediction"] for r in sorted(got)] == [2.0, 3.0] and not any(r["cached"] for r in got)


def test_prediction_shape(spark):
    rows = spark.createDataFrame([(0.0, Vectors.dense([0.8, 0.2])), (1.0, Vectors.dense([0.3, 0.7]))], ["prediction", "probability"])
    got = prediction_rows(rows, now(), "lda", "3").collect()
    assert got[1]["probabilities"] == {"class_0": 0.3, "class_1": 0.7} and got[0]["confidence"] == 0.8
    assert "probabilities" not in prediction_rows(rows.drop("probability"), now(), "lda").columns


def test_coercion(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "a short, d date")
    assert coerce(df, ["a"]).schema["a"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="z"):
        coerce(df, ["z"])


def test_digest_ignores_row_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert table_digest(df).first() == table_digest(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert table_digest(df).first() != table_digest(df.where("id > 0")).first()


def test_readers(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿id\tname\n1\ta\n2\tb\n".encode("utf-8"))
    df = readers.read_table(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["id", "name"] and df.count() == 2
    (tmp_path / "latin.csv").write_bytes("id;name\n1;\xe9,x\n2;b\n".encode("latin1"))
    assert readers.detect_encoding(spark, str(tmp_path / "latin.csv")) == "latin1"
    assert [r["name"] for r in readers.read_table(spark, str(tmp_path / "latin.csv")).collect()] == ["é,x", "b"]
    for name in ("a.xlsx", "a.txt", "a"):
        with pytest.raises(ValueError):
            readers.file_format(name)
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "bom.csv"), max_bytes=5)


def test_stream_cooldown_over_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[int(rng.integers(0, 2))], base + dt.timedelta(seconds=40 * i)) for i in range(300)]
    schema = "id long, k string, ts timestamp"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.start(jobs.streaming_cooldown(stream, "k", "ts", "id", 600), f"{tmp_path}/out").awaitTermination()
    got = {r["id"] for r in spark.read.parquet(f"{tmp_path}/out/data").where("passed").collect()}
    want, last = set(), {}
    for i, k, ts in rows:
        if k not in last or (ts - last[k]).total_seconds() >= 600:
            last[k] = ts
            want.add(i)
    assert got == want


def test_delimiter_of_all_lines(spark, tmp_path):
    lines = ["x,y;z"] + ["1,2;3"] * 60 + ['"a;b";3', "", '4;"c,d']  * 100
    (tmp_path / "late.csv").write_text("\n".join(lines))
    (tmp_path / "none.csv").write_text("")
    assert readers.detect_delimiter(spark, str(tmp_path / "late.csv")) == ";"
    assert readers.detect_delimiter(spark, str(tmp_path / "none.csv")) == ","


def test_streaming_centres(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [([float(v) for v in rng.normal(size=2) + 6 * (i % 2)],) for i in range(200)]
    df = spark.createDataFrame(rows, "features array<double>")
    df.write.parquet(f"{tmp_path}/in")
    model = estimator("minibatch_kmeans", "clustering", n_clusters=2, rounds=1).fit(df)
    before = model.counts.sum()
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.run_centres(stream, model, f"{tmp_path}/out").awaitTermination()
    assert model.counts.sum() == before + 200
    assert np.allclose(read_plain(spark, tmp_path).centres, model.centres)


def read_plain(spark, tmp_path):
    from modelyard.operators.plain import load_plain

    return load_plain(spark, f"{tmp_path}/out/model")
