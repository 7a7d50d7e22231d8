"""Every registered query with SQL gives the same rows as the SQL on the given tables."""

import pytest
from checker import compare, duck

from modelyard.plans.catalog import Tables, load_all

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_all()
CHECKED = sorted(n for n, (_, sql) in REGISTRY.items() if sql)
# Training is covered by test_models; these rows-only queries are cheap.
UNCHECKED = ["drift_report", "feature_status", "hash_folds", "iterative_impute", "knn_impute", "outliers", "predict_pipeline"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, con, name):
    function, sql = REGISTRY[name]
    # At this scale some windows and classes are empty; the SQL is, too.
    problem = compare(function(Tables(spark, FOLDER)), con, sql)
    assert problem in ("", "no rows")


@pytest.mark.parametrize("name", UNCHECKED)
def test_gives_rows(spark, name):
    assert not REGISTRY[name][0](Tables(spark, FOLDER)).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())
