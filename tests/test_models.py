import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from modelyard import settings
from modelyard.operators import boosting, clustering, explain, partitioning, search, spectrum
from modelyard.operators.models import FACTORIES, estimator, model_names
from modelyard.plans.pipelines import evaluate

RNG = np.random.default_rng(0)
N = 240
CLASS = RNG.integers(0, 3, N)
X = RNG.normal(size=(N, 4)) + np.array([[0, 0, 0, 0], [4, 0, 0, 0], [0, 4, 0, 0]])[CLASS]
LINE = X @ np.array([1.0, 2.0, -1.0, 0.5]) + RNG.normal(size=N) * 0.1


def table(spark, label, x=X):
    rows = [(i, Vectors.dense(r), float(y)) for i, (r, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, ["key", "features", "label"]).repartition(4)


SMALL = {
    "random_forest": {"n_estimators": 8, "max_depth": 4},
    "extra_trees": {"n_estimators": 8, "max_depth": 4},
    "ada_boost": {"n_estimators": 6},
    "mlp": {"max_iter": 50, "hidden": [8]},
    "linear_svc": {"max_iter": 10},
    "sgd": {"max_iter": 10},
}
for _name in ("gradient_boosting", "hist_gradient_boosting", "xgboost", "lightgbm"):
    SMALL[_name] = {"n_estimators": 4}
SMALL["catboost"] = {"iterations": 4}


@pytest.mark.parametrize("name", sorted(set(FACTORIES["classification"]) - {"sgd", "hist_gradient_boosting", "lightgbm", "catboost"}))
def test_classifiers(spark, name):
    df = table(spark, CLASS, np.abs(X) if name == "multinomial_nb" else X).persist()
    model = estimator(name, "classification", **SMALL.get(name, {})).fit(df)
    assert search.score(model, df, "classification") > 0.8


@pytest.mark.parametrize("name", sorted(FACTORIES["regression"]))
def test_regressors(spark, name):
    df = table(spark, LINE).persist()
    model = estimator(name, "regression", **SMALL.get(name, {})).fit(df)
    assert -search.score(model, df, "regression") < 0.6 * LINE.var()


@pytest.mark.parametrize(("task", "label"), [("classification", CLASS), ("regression", LINE)])
def test_adaboost_writes_and_keeps_nothing_for_no_round(spark, task, label, monkeypatch):
    """After the last tree no weights are written, and no rows stay behind; five rounds are the first five of seven."""
    written, cut = [], boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: written.append(df) or cut(df))
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    df, before = table(spark, label), kept()
    five = estimator("ada_boost", task, n_estimators=5).fit(df)
    assert not written and kept() <= before
    seven = estimator("ada_boost", task, n_estimators=7).fit(df)
    assert len(written) == (len(seven.trees) > 5) and kept() <= before + len(written)
    text = lambda model: [tree.toDebugString.split("\n", 1)[1] for tree in model.trees[:5]]
    assert len(five.trees) == 5 and text(five) == text(seven) and np.allclose(five.weights, seven.weights[:5], rtol=1e-12)


def test_ridge_matches_the_closed_form(spark):
    model = estimator("ridge", "regression", alpha=5.0).fit(table(spark, LINE))
    xc = X - X.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(4), xc.T @ (LINE - LINE.mean()))
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)


def test_elastic_net_meets_its_conditions(spark):
    model = estimator("elastic_net", "regression", alpha=0.4, l1_ratio=0.3).fit(table(spark, LINE))
    w = model.coefficients.toArray()
    xc = X - X.mean(axis=0)
    pull = xc.T @ (LINE - LINE.mean() - xc @ w) / N - 0.4 * 0.7 * w
    for slope, weight in zip(pull, w):
        assert abs(slope - 0.12 * np.sign(weight)) < 1e-4 if weight else abs(slope) <= 0.12 + 1e-6


def test_discriminant_and_ridge_votes(spark):
    df = table(spark, CLASS)
    lda = estimator("lda", "classification").fit(df)
    means = np.array([X[CLASS == c].mean(axis=0) for c in range(3)])
    cov = sum((X[CLASS == c] - means[c]).T @ (X[CLASS == c] - means[c]) for c in range(3)) / (N - 3)
    w = means @ np.linalg.inv(cov)
    b = np.log(np.bincount(CLASS) / N) - 0.5 * (w * means).sum(axis=1)
    want = (X @ w.T + b).argmax(axis=1)
    got = {r["key"]: r["prediction"] for r in lda.transform(df).collect()}
    assert all(got[i] == want[i] for i in range(N))
    votes = estimator("ridge", "classification", alpha=2.0).fit(df)
    xc = X - X.mean(axis=0)
    y = np.where(CLASS[:, None] == np.arange(3), 1.0, -1.0)
    coef = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(4), xc.T @ (y - y.mean(axis=0)))
    assert np.allclose(votes.weights, coef.T, atol=1e-8)
    assert np.allclose(votes.offsets, y.mean(axis=0) - X.mean(axis=0) @ coef, atol=1e-8)


def test_projections(spark):
    df = table(spark, CLASS)
    pca = estimator("pca", "dimensionality_reduction", n_components=2).fit(df)
    _, s, vt = np.linalg.svd(X - X.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(pca.components), np.abs(vt[:2]), atol=1e-8)
    assert np.allclose(pca.explained_variance, s[:2] ** 2 / (N - 1))
    svd = estimator("truncated_svd", "dimensionality_reduction", n_components=2).fit(df)
    _, s, vt = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(svd.singular_values, s[:2]) and np.allclose(np.abs(svd.components), np.abs(vt[:2]), atol=1e-8)
    out = np.array([r["reduced"].toArray() for r in svd.transform(df).orderBy("key").collect()])
    assert np.allclose(out, X @ svd.components.T)
    assert 0 < search.score(svd, df, "dimensionality_reduction") <= 1


def test_independent_components(spark):
    rng = np.random.default_rng(1)
    sources = np.column_stack([rng.uniform(-1, 1, 800), rng.laplace(size=800)])
    mixed = sources @ np.array([[1.0, 0.5], [0.4, 1.2]]).T
    df = table(spark, np.zeros(800), mixed)
    model = estimator("fast_ica", "dimensionality_reduction").fit(df)
    out = np.array([r["reduced"].toArray() for r in model.transform(df).orderBy("key").collect()])
    match = np.abs(np.corrcoef(out.T, sources.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.97


def test_non_negative_factors(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(150, 2)) @ rng.uniform(size=(2, 5))
    df = table(spark, np.zeros(150), x)
    model = estimator("nmf", "dimensionality_reduction", n_components=2).fit(df)
    w = np.array([r["reduced"].toArray() for r in model.transform(df).orderBy("key").collect()])
    assert (w >= 0).all() and (model.components >= 0).all()
    assert np.linalg.norm(w @ model.components - x) / np.linalg.norm(x) < 0.05
    with pytest.raises(ValueError):
        estimator("nmf", "dimensionality_reduction").fit(table(spark, CLASS))


def brute_dbscan(x, eps, m):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = gap.sum(axis=1) >= m
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for k in np.flatnonzero(gap[todo.pop()] & core):
                    if label[k] < 0:
                        label[k] = i
                        todo.append(k)
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(gap[i] & core)
        if len(near):
            label[i] = label[near.min()]
    return label


@pytest.mark.parametrize("block_rows", [37, 5000])
def test_dbscan(spark, block_rows):
    x = np.vstack([RNG.normal(size=(70, 2)) * 0.4 + c for c in ((0, 0), (3, 3), (0, 4))] + [RNG.uniform(-3, 7, size=(30, 2))])
    want = brute_dbscan(x, 0.5, 5)
    df = table(spark, np.zeros(len(x)), x)
    got = {r["key"]: r["cluster"] for r in partitioning.dbscan(df, "key", 0.5, 5, block_rows).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_components_of_a_long_path(spark):
    nodes = spark.range(400).select(F.col("id").alias("key"))
    edges = spark.range(399).where("id <> 200").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = partitioning.connected_components(nodes, edges).groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(r) for r in got] == [(0, 201), (201, 199)]


def test_silhouette_in_blocks(spark):
    df = table(spark, CLASS)
    whole = clustering.silhouette(df, "features", "label", "key").first()[0]
    pieces = clustering.silhouette(df, "features", "label", "key", block_rows=31).first()[0]
    gap = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    scores = []
    for i in range(N):
        own = (CLASS == CLASS[i]) & (np.arange(N) != i)
        a = gap[i][own].mean()
        b = min(gap[i][CLASS == c].mean() for c in range(3) if c != CLASS[i])
        scores.append((b - a) / max(a, b))
    assert abs(whole - np.mean(scores)) < 1e-12 and abs(pieces - whole) < 1e-12


@pytest.mark.parametrize("name", ["kmeans", "hierarchical", "minibatch_kmeans"])
def test_clusterers(spark, name):
    df = table(spark, CLASS)
    model = estimator(name, "clustering", n_clusters=3).fit(df)
    metrics = {r["metric"]: r["value"] for r in evaluate(model, df, "clustering", "key").collect()}
    assert metrics["silhouette"] > 0.2 and metrics["calinski_harabasz"] > 50


def test_every_row_moves_a_centre(spark):
    rows = [([float(v) for v in r],) for r in np.random.default_rng(1).normal(size=(3000, 2))]
    df = spark.createDataFrame(rows, "features array<double>")
    for batch_rows, rounds, seen in ((100, 5, 3000), (1000, 3, 3000), (1000, 6, 6000)):
        model = estimator("minibatch_kmeans", "clustering", n_clusters=3, batch_rows=batch_rows, rounds=rounds).fit(df)
        assert model.counts.sum() == seen


def test_every_row_is_explained(spark):
    model = estimator("linear_regression", "regression").fit(table(spark, LINE))
    found = explain.sampled_shapley(table(spark, LINE), "key", model, ["a", "b", "c", "d"], permutations=2)
    assert N > 100 and found.count() == 4 * N and found.select("key").distinct().count() == N


class CountedModel:
    """x0 * x1 + max(x2, x3), and how many rows it has been given."""

    def __init__(self):
        self.seen = 0

    def transform(self, df):
        self.seen += df.count()
        x = vector_to_array("features")
        return df.withColumn("prediction", x[0] * x[1] + F.greatest(x[2], x[3]))


def test_shapley_scores_no_mixture_twice(spark):
    """Equal to a plain walk through the permutations, keys that come twice add up; a whole row and a background row are scored once."""
    x = np.random.default_rng(3).normal(size=(40, 4))
    x[1:10:2] = x[0:10:2]
    rows = [(i // 2 if i < 10 else i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, features array<double>").repartition(3)
    model, permutations = CountedModel(), 5
    found = {(r["key"], r["feature"]): r["value"] for r in explain.sampled_shapley(df, "key", model, list("abcd"), permutations=permutations).collect()}
    background = [r["features"] for r in df.orderBy(explain.draw(["key"], settings.RANDOM_STATE + 1)).limit(explain.BACKGROUND_ROWS).collect()]
    rng, want = random.Random(settings.RANDOM_STATE), Counter()
    score = lambda v: v[0] * v[1] + max(v[2], v[3])
    for _ in range(permutations):
        order = list(range(4))
        rng.shuffle(order)
        base = background[rng.randrange(len(background))]
        for key, row in rows:
            now = list(base)
            for f in order:
                before, now[f] = score(now), row[f]
                want[key, "abcd"[f]] += (score(now) - before) / permutations
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert model.seen <= len(rows) * (permutations * 3 + 1) + permutations
    line = spark.createDataFrame([(1, [2.0]), (2, [5.0])], "key long, features array<double>")
    one = estimator("linear_regression", "regression").fit(line.withColumn("label", F.get("features", F.lit(0)) * 3).withColumn("features", array_to_vector("features")))
    got = {r["key"]: r["value"] for r in explain.sampled_shapley(line, "key", one, ["a"], permutations=3).collect()}
    assert abs(got[2] - got[1] - 9.0) < 1e-6


def test_clustering_metrics_have_one_name_at_all_sizes(spark, monkeypatch):
    for name in ("silhouette", "silhouette_squared", "calinski_harabasz", "davies_bouldin"):
        monkeypatch.setattr(clustering, name, lambda *_, name=name: spark.range(1).select(F.lit(0.5).alias(name)))
    df = spark.range(50_001)
    named = lambda **options: {r["metric"] for r in clustering.evaluate_clustering(df, "f", "c", "id", **options).collect()}
    assert named() == {"silhouette", "calinski_harabasz", "davies_bouldin"}
    assert named(shape="silhouette_squared") == {"silhouette_squared", "calinski_harabasz", "davies_bouldin"}


def test_spectral(spark):
    df = table(spark, CLASS)
    got = spectrum.spectral(df, "key", 3).join(df.select("key", "label"), "key")
    best = got.groupBy("cluster", "label").count().groupBy("label").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert best > 0.8 * N


def test_importance_and_shapley(spark):
    df = table(spark, LINE)
    names = ["a", "b", "c", "d"]
    model = estimator("linear_regression", "regression").fit(df)
    shares = {r["feature_name"]: r["importance_score"] for r in explain.feature_importance(spark, model, names).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == "b"
    exact = explain.linear_shapley(df, "key", model.coefficients, names)
    got = exact.groupBy("key").agg(F.sum("value").alias("s")).join(model.transform(df), "key")
    mean = model.transform(df).agg(F.avg("prediction")).first()[0]
    assert got.agg(F.max(F.abs(F.col("s") + mean - F.col("prediction")))).first()[0] < 1e-9
    sampled = explain.sampled_shapley(df, "key", model, names, sample_rows=20, permutations=8)
    assert sampled.count() == 20 * 4
    # For a linear model a value is weight times the distance from the mean background row drawn.
    part = {(r["key"], r["feature"]): r["value"] for r in sampled.collect()}
    keys = sorted({k for k, _ in part})
    slope = [(part[(keys[0], n)] - part[(keys[1], n)]) / (X[keys[0], i] - X[keys[1], i]) for i, n in enumerate(names)]
    assert np.allclose(slope, model.coefficients.toArray(), atol=1e-8)
    with pytest.raises(ValueError):
        explain.feature_importance(spark, model, ["a"])


def test_search(spark):
    df = table(spark, (CLASS > 0).astype(float))
    ranges = {"random_forest": {"n_estimators": (3, 6), "max_depth": (2, 4), "min_samples_split": (2, 9), "min_samples_leaf": (1, 3)}}
    found = search.search(df, "classification", ["key"], n_trials=3, folds=3, names=["lda", "random_forest"], ranges=ranges)
    assert len(found["trials"]) == 3 and found["best"]["value"] > 0.8
    assert search.trial_table(spark, found["trials"]).count() == 3
    assert search.draw_trials("classification", 5, 7) == search.draw_trials("classification", 5, 7)


def test_settling():
    assert not search.has_settled([0.5] * 9)
    assert search.has_settled([0.1] + [0.5] * 10)
    assert not search.has_settled([0.5] * 9 + [0.502])


def test_names_and_errors(spark):
    assert "dbscan" in model_names("clustering")
    with pytest.raises(ValueError):
        estimator("svc", "classification")
    with pytest.raises(ValueError):
        evaluate(None, table(spark, CLASS), "ranking")
