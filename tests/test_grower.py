"""Trees grown level by level, against plain versions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import CLASS, LINE, N, X, table

from modelyard.operators import grower, search
from modelyard.operators.explain import importance_values
from modelyard.operators.grower import ExtraTrees, SecondOrderBoosting, Tree, ordered_target_statistics
from modelyard.operators.models import estimator
from modelyard.sources.store import read_model, write_model


def plain_tree(x, g, h, depth, l2, style, leaves=1 << 30, least=1):
    """Leaves as sets of rows, grown on all distinct values."""

    def part(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + l2)

    def splits(rows):
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= least:
                    yield (part(left) + part(right) - part(rows)) / 2, f, cut, left, right

    def best(rows):
        found = list(splits(rows))
        return max(found, key=lambda s: (s[0], -s[1], -s[2])) if found else None

    todo, done = [(0, np.arange(len(x)))], []
    if style == "level":
        for _ in range(depth):
            gains = {}
            for _, rows in todo:
                for gain, f, cut, *_ in splits(rows):
                    gains[f, cut] = gains.get((f, cut), 0) + gain
            f, cut = max(gains, key=lambda s: (gains[s], -s[0], -s[1]))
            todo = [(0, side) for _, rows in todo for side in (rows[x[rows, f] <= cut], rows[x[rows, f] > cut])]
        return [rows for _, rows in todo if len(rows)]
    while todo:
        if style == "leaf":
            able = [(best(rows), i) for i, (_, rows) in enumerate(todo)]
            able = [(b, i) for b, i in able if b and b[0] > 1e-9]
            if not able or len(todo) >= leaves:
                return [rows for _, rows in todo]
            b, i = max(able, key=lambda s: s[0][0])
            todo = todo[:i] + todo[i + 1 :] + [(0, b[3]), (0, b[4])]
        else:
            level, rows = todo.pop()
            b = best(rows) if level < depth else None
            if b is None or b[0] <= 1e-9:
                done.append(rows)
            else:
                todo += [(level + 1, b[3]), (level + 1, b[4])]
    return done


@pytest.mark.parametrize(("style", "options"), [("depth", {"max_depth": 3}), ("level", {"max_depth": 3}), ("leaf", {"max_leaves": 6, "least_rows": 5})])
def test_first_tree_of_each_way_of_growing(spark, style, options):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 6) * x[:, 2] + rng.normal(size=200)
    df = table(spark, y, x)
    model = SecondOrderBoosting("regression", style, n_estimators=1, **options).fit(df)
    l2, rate = grower.STYLES[style]["l2"], grower.STYLES[style]["learning_rate"]
    g = y.mean() - y
    want = plain_tree(x, g, np.ones(200), options.get("max_depth", 99), l2, style, options.get("max_leaves", 1 << 30), options.get("least_rows", 1))
    values = np.zeros(200)
    for rows in want:
        values[rows] = y.mean() - rate * g[rows].sum() / (len(rows) + l2)
    got = {r["key"]: r["prediction"] for r in model.transform(df).collect()}
    assert np.abs([got[i] - values[i] for i in range(200)]).max() < 1e-9


def test_leaf_values_are_those_of_gradient_and_hessian(spark):
    df = table(spark, (CLASS > 0).astype(float))
    model = estimator("xgboost", "classification", n_estimators=4, max_depth=3).fit(df)
    for number in range(4):
        rows = model.leaf_rows(df, number).select("leaf", "margin", "label")
        p = 1 / (1 + F.exp(-F.col("margin")))
        sums = rows.groupBy("leaf").agg(F.sum(p - F.col("label")).alias("g"), F.sum(p * (1 - p)).alias("h"))
        tree = model.rounds()[number][0]
        for r in sums.collect():
            assert abs(tree.value[r["leaf"]][0] + 0.3 * r["g"] / (r["h"] + 1.0)) < 1e-9


def test_three_designs_are_three_models(spark):
    df = table(spark, CLASS)
    models = {n: estimator(n, "classification", **{k: 5}).fit(df) for n, k in (("xgboost", "n_estimators"), ("lightgbm", "n_estimators"), ("catboost", "iterations"))}
    shapes = {n: [sorted(t.feature) for c in m.rounds() for t in c] for n, m in models.items()}
    assert len({str(s) for s in shapes.values()}) == 3
    for tree in (t for c in models["catboost"].rounds() for t in c):
        # Every node of a level has the same split.
        for level in range(6):
            own = {(tree.feature[i], tree.threshold[i]) for i, p in enumerate(tree.path) if p.bit_length() - 1 == level and tree.feature[i] >= 0}
            assert len(own) <= 1
    assert max(sum(f < 0 for f in t.feature) for c in models["lightgbm"].rounds() for t in c) <= 31
    for model in models.values():
        assert search.score(model, df, "classification") > 0.8 and abs(sum(importance_values(model)) - 1) < 1e-9
    weak, strong = (estimator("catboost", "regression", iterations=3, l2_leaf_reg=l2).fit(table(spark, LINE)).rounds()[0][0] for l2 in (0.0, 500.0))
    assert max(abs(v[0]) for v in strong.value) < max(abs(v[0]) for v in weak.value)


@pytest.mark.parametrize(("name", "task"), [("extra_trees", "classification"), ("lightgbm", "classification"), ("catboost", "regression"), ("extra_trees", "regression")])
def test_growers_are_stored_and_read(spark, tmp_path, name, task):
    df = table(spark, CLASS if task == "classification" else LINE)
    options = {"n_estimators": 3} if name != "catboost" else {"iterations": 3}
    model = estimator(name, task, **options).fit(df)
    write_model(spark, model, str(tmp_path / "m"))
    again = read_model(spark, str(tmp_path / "m"))
    rows = [{r["key"]: r["prediction"] for r in m.transform(df).collect()} for m in (model, again)]
    assert rows[0] == rows[1] and len(set(rows[0].values())) > 1


def test_extra_trees_draw_their_cuts(spark):
    df = table(spark, CLASS)
    first, again, other = (ExtraTrees("classification", n_estimators=4, max_depth=4, seed=s).fit(df) for s in (1, 1, 2))
    cuts = [[t.threshold for t in m.grown] for m in (first, again, other)]
    assert cuts[0] == cuts[1] != cuts[2]
    # A cut is seldom a value of the table, and lies between values of its node.
    values = set(X.ravel().tolist())
    drawn = [c for t in first.grown for c, f in zip(t.threshold, t.feature) if f >= 0]
    assert len(drawn) > 20 and sum(c in values for c in drawn) == 0
    for tree in first.grown:
        leaf = tree.leaves(X)
        for node in np.unique(leaf):
            assert tree.value[node] == [float(((leaf == node) & (CLASS == c)).sum()) for c in range(3)]
        assert sum(tree.value[0]) == N
    assert search.score(first, df, "classification") > 0.8


def test_groups_of_nodes_give_the_same_forest(spark, monkeypatch):
    df = table(spark, LINE)
    whole = ExtraTrees("regression", n_estimators=3, max_depth=4).fit(df)
    monkeypatch.setattr(grower, "TABLE_SIZE", 30)
    parts = ExtraTrees("regression", n_estimators=3, max_depth=4).fit(df)
    assert sorted(r["path"] for r in whole.nodes(spark).collect()) == sorted(r["path"] for r in parts.nodes(spark).collect())
    a, b = ({r["key"]: r["prediction"] for r in m.transform(df).collect()} for m in (whole, parts))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_constant_labels_and_columns(spark):
    flat = table(spark, np.ones(40), np.ones((40, 2)))
    for name in ("extra_trees", "xgboost", "lightgbm", "catboost"):
        found = estimator(name, "regression").fit(flat).transform(flat).agg(F.min("prediction"), F.max("prediction")).first()
        assert abs(found[0] - 1) < 1e-12 and abs(found[1] - 1) < 1e-12
    with pytest.raises(ValueError):
        estimator("xgboost", "regression").fit(flat.limit(0))


def test_a_tree_walks_rows():
    tree = Tree()
    left, right = tree.split(0, 1, 0.5, 1.0)
    deep = tree.split(right, 0, 2.0, 1.0)
    assert tree.path == [1, 2, 3, 6, 7]
    assert tree.leaves(np.array([[0.0, 0.5], [2.0, 1.0], [2.1, 1.0]])).tolist() == [left, deep[0], deep[1]]


def test_ordered_target_statistics_see_earlier_rows_only(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(i % 3) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string, y double").repartition(4)
    got = {r["id"]: r["ts"] for r in ordered_target_statistics(df, "c", "y", ["id"], 2.0, 9).collect()}
    order = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(9), "id").alias("h")).collect()}
    labels = [y for _, _, y in rows if y is not None]
    mean = sum(labels) / len(labels)
    for i, c, _ in rows:
        before = [y for j, d, y in rows if d == c and order[j] < order[i] and y is not None]
        assert abs(got[i] - (sum(before) + 2.0 * mean) / (len(before) + 2.0)) < 1e-12


def test_batches_are_packed_once(spark):
    """The passes read one row per batch, with the numbers of all its rows."""
    from modelyard.operators.grower import packed, unpacked

    rows = spark.range(1000, numPartitions=2).selectExpr("array(double(id), -id / 7) AS features", "double(id % 3) AS label", "array(0.5D) AS margin")
    edges = [np.array([10.0, 500.0]), np.array([-50.0])]
    made = packed(rows, edges).toPandas()
    parts = list(unpacked([made]))
    assert len(made) == 2 and made["n"].sum() == 1000
    x = np.vstack([p["x"] for p in parts])
    assert sorted(x[:, 0]) == list(range(1000)) and np.allclose(x[:, 1], -x[:, 0] / 7)
    assert (np.concatenate([p["label"] for p in parts]) == x[:, 0] % 3).all() and (np.vstack([p["margin"] for p in parts]) == 0.5).all()
    assert (np.hstack([p["bins"] for p in parts]) == [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]).all()


def test_leaves_are_looked_at_a_level_a_pass(spark, monkeypatch):
    """A best-first tree of 16 leaves took 16 passes, one per split; its rows come as pieces in which equal bins are one row."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 8, size=(2000, 2)).astype(float)
    y = 10 * x[:, 0] + x[:, 1] + rng.normal(size=2000)
    df = table(spark, y, x)
    passes, seen = [], grower.SecondOrderBoosting._best_splits
    monkeypatch.setattr(grower.SecondOrderBoosting, "_best_splits", lambda self, *a: passes.append(len(a[2])) or seen(self, *a))
    model = SecondOrderBoosting("regression", "leaf", n_estimators=1, max_leaves=16, least_rows=5).fit(df)
    tree = model.rounds()[0][0]
    assert sum(f < 0 for f in tree.feature) == 16 and len(passes) <= 7
    g = y.mean() - y
    want = sorted(-0.1 * g[rows].mean() for rows in plain_tree(x, g, np.ones(2000), 99, 0.0, "leaf", 16, 5))
    assert np.allclose(sorted(v[0] for v, f in zip(tree.value, tree.feature) if f < 0), want, atol=1e-9)


def test_equal_bins_of_a_chunk_are_one_row(spark, monkeypatch):
    monkeypatch.setattr(grower, "PIECE_ROWS", 5)
    rows = [(i % 6, float(i % 2) if i % 7 else None, float(i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, label double".replace("a double", "a int")).repartition(2)
    df = df.selectExpr("array(double(a), coalesce(b, double('NaN'))) AS features", "label")
    edges = [np.array([0.0, 2.0, 4.0]), np.array([0.0])]
    for by_label in (False, True):
        made = grower.binned(df, edges, [0.25], False, by_label).toPandas()
        assert made["n"].max() <= 5 and "x" not in made
        parts = list(grower.unpacked([made], grower.bin_kind(edges)))
        assert sum(p["weight"].sum() for p in parts) == 600 and sum(len(p["weight"]) for p in parts) < 100
        assert sum((p["weight"] * p["label"]).sum() for p in parts) == sum(r[2] for r in rows)
        assert all((p["margin"] == 0.25).all() for p in parts) and {b for p in parts for b in p["bins"][1]} == {0, 1, 2}
    drawn = grower.binned(df, edges, [0.25], True, False).toPandas()
    assert drawn["n"].sum() == 600 and "x" in drawn
