"""Searches with failing and slow trials, and preparation of tables with gaps."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import CLASS, N, table

from modelyard.functions.values import table_digest
from modelyard.operators import impute, search
from modelyard.operators.models import estimator
from modelyard.operators.prepare import Prepared, fit_preparation


def test_a_failing_trial_is_a_row(spark):
    df = table(spark, CLASS)
    found = search.search(df, "classification", ["key"], n_trials=8, folds=2, names=["multinomial_nb", "gaussian_nb", "lda"], patience=99)
    rows = search.trial_table(spark, found["trials"]).collect()
    failed = [r for r in rows if r["error"] is not None]
    assert len(rows) == 8 and failed and {r["model"] for r in failed} == {"multinomial_nb"}
    assert all(r["value"] is None for r in failed) and all(r["value"] > 0.8 for r in rows if r["error"] is None)
    assert found["best"]["model"] in ("gaussian_nb", "lda") and found["model"].transform(df).count() == N
    with pytest.raises(RuntimeError, match="no trial has finished: multinomial_nb"):
        search.search(df, "classification", ["key"], n_trials=1, folds=2, names=["multinomial_nb"])


def test_time_ends_a_slow_trial(spark, monkeypatch):
    df = table(spark, CLASS)
    real = search.estimator

    def slow(name, task, **params):
        if name != "lda":
            return real(name, task, **params)

        class Slow:
            def fit(self, rows):
                wait = F.udf(lambda x: time.sleep(5) or x, "double")
                rows.select(wait("label").alias("x")).agg(F.sum("x")).collect()

        return Slow()

    monkeypatch.setattr(search, "estimator", slow)
    began = time.monotonic()
    with pytest.raises(RuntimeError, match="no trial has finished"):
        search.search(df, "classification", ["key"], n_trials=1, folds=2, names=["lda"], timeout=3)
    assert time.monotonic() - began < 60
    assert not [t for t in threading.enumerate() if isinstance(t, threading.Timer)]
    # The session goes on, and later jobs are not cancelled.
    assert search.search(df, "classification", ["key"], n_trials=1, folds=2, names=["gaussian_nb"])["best"]["value"] > 0.8


def test_neighbours_need_no_key_column(spark):
    df = table(spark, CLASS).withColumnRenamed("key", "row_id")
    model = estimator("knn", "classification").fit(df)
    out = model.transform(df)
    assert out.columns == ["row_id", "features", "label", "prediction", "probability"] and out.count() == N
    assert search.score(model, df, "classification") > 0.8


def gappy(spark):
    rows = [(i, None if i % 3 else float(i), float("nan") if i % 4 == 0 else float(i % 5), None, "abc"[i % 3] if i % 7 else None, float(i % 2)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, a double, b double, empty double, kind string, y double")


def test_preparation_of_an_empty_column(spark):
    df = gappy(spark)
    prepared = fit_preparation(df, "y", "classification", ["id"])
    assert prepared.numeric == ["a", "b"] and "empty" in prepared.dropped
    again = Prepared.from_json(prepared.to_json())
    rows = again.transform(df, keep=["id"]).collect()
    assert len(rows) == 60 and all(np.isfinite(r["features"].toArray()).all() for r in rows)


@pytest.mark.parametrize("imputer", ["iterative", "mean", "median"])
def test_preparation_without_numbers(spark, imputer):
    df = gappy(spark).select("id", "kind", "empty", "y")
    prepared = fit_preparation(df, "y", "classification", ["id"], imputer=imputer)
    assert prepared.numeric == [] and prepared.categorical == ["kind"]
    assert prepared.transform(df, keep=["id"]).select("features").distinct().count() == 4


def test_simple_fills_take_nan_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, float("nan"), None), (3, 7.0, "x"), (4, None, "y")], "id long, v double, s string")
    fills = impute.fit_simple(df, ["v", "s"], "most_frequent")
    assert fills == {"v": 7.0, "s": "x"}
    rows = {r["id"]: (r["v"], r["s"]) for r in impute.apply_simple(df, fills).collect()}
    assert rows == {1: (7.0, "x"), 2: (7.0, "x"), 3: (7.0, "x"), 4: (7.0, "y")}


def test_digest_sees_which_column_is_empty(spark):
    one, other = (spark.createDataFrame([r], "a long, b long") for r in ((1, None), (None, 1)))
    assert table_digest(one).first() != table_digest(other).first()
