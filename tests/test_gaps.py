"""NULL groups and missing values."""

import pytest
from pyspark.sql import functions as F

from modelyard.operators.alerts import cooldown
from modelyard.operators.ordered import with_previous
from modelyard.operators.scale import fit_power
from modelyard.operators.select import anova_scores, mutual_information, regression_scores
from modelyard.operators.split import balanced_weights, stratified_folds, stratified_split


@pytest.fixture(scope="module")
def rows(spark):
    group = F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string"))
    return spark.range(100).select("id", group.alias("label"), (F.col("id") * 7 % 31).cast("double").alias("x")).cache()


def test_rows_without_a_group_stay(rows):
    train, test = stratified_split(rows, "label", "id")
    assert (train.count(), test.count()) == (80, 20)
    assert test.where("label IS NULL").count() == 5
    assert stratified_folds(rows, "id", "label", 5).groupBy("label", "fold").count().where("count <> 5").count() == 0
    assert balanced_weights(rows, "label").agg(F.count("weight"), F.sum("weight")).first() == (100, 100.0)
    steps = with_previous(rows, ["x"], "id", ["label"])
    assert steps.count() == 100 and steps.where("prev_x IS NULL").count() == 4


def test_alerts_without_a_key_have_a_timer(spark):
    alerts = spark.range(10).select(F.lit(None).cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 100).alias("at"), "id")
    passed = cooldown(alerts, ["key"], "at", "id", seconds=250).where("passed").select("id").orderBy("id").collect()
    assert [r["id"] for r in passed] == [0, 3, 6, 9]


def test_scores_leave_missing_values_out(rows):
    labelled = rows.where("label IS NOT NULL").withColumn("y", F.col("label").cast("double"))
    gap = F.col("id") % 5 == 0
    dirty = labelled.withColumn("x", F.when(gap & (F.col("id") % 2 == 0), F.lit(float("nan"))).when(~gap, F.col("x")))
    clean = labelled.where(~gap)
    for scores, target in ((anova_scores, "label"), (regression_scores, "y"), (mutual_information, "label")):
        mine, plain = (scores(t, ["x"], target).first()["score"] for t in (dirty, clean))
        assert mine == pytest.approx(plain)
    assert fit_power(dirty, ["x"])["x"] == pytest.approx(fit_power(clean, ["x"])["x"])
    empty = labelled.withColumn("x", F.when(F.col("label") != "1", F.col("x")))
    assert anova_scores(empty, ["x"], "label").first()["score"] == pytest.approx(anova_scores(labelled.where("label <> '1'"), ["x"], "label").first()["score"])
