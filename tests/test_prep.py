import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modelyard.functions.vectors import pack_sums
from modelyard.operators import encode, impute, outliers, prepare, profile, scale, select, split

FX1 = [(1.0, 10, "A", "X", 0), (2.0, 20, "B", "Y", 1), (3.0, 30, "A", "Z", 0), (None, 40, None, "X", 1), (5.0, 50, "C", "Y", 1)]
FX1_SCHEMA = "numeric_1 double, numeric_2 long, categorical_1 string, categorical_2 string, target long"


def test_roles_and_fixture(spark):
    df = spark.createDataFrame(FX1, FX1_SCHEMA)
    roles = profile.column_roles(df, "target")
    assert roles == {"numeric": ["numeric_1", "numeric_2"], "categorical": ["categorical_1", "categorical_2"], "dropped": []}
    prepared = prepare.fit_preparation(df, "target", "classification")
    rows = prepared.transform(df).select(vector_to_array("features").alias("x"), "label").collect()
    assert len(rows) == 5
    assert all(v is not None and not np.isnan(v) for r in rows for v in r["x"])
    # Two numbers, {A, B, C, missing} and {X, Y, Z} without their first.
    assert prepared.feature_names == [
        "numeric_1", "numeric_2", "categorical_1_B", "categorical_1_C", "categorical_1_missing", "categorical_2_Y", "categorical_2_Z",
    ]
    new = spark.createDataFrame([(1.5, 15, "B", "X"), (None, 25, "D", "Y")], FX1_SCHEMA.rsplit(",", 1)[0])
    again = prepare.Prepared.from_json(prepared.to_json())
    found = [r["x"] for r in again.transform(new).select(vector_to_array("features").alias("x")).collect()]
    assert len(found) == 2 and not np.isnan(np.array(found)).any()
    assert any(row[2:5] == [0.0, 0.0, 0.0] for row in found)


def test_infer_task(spark):
    few = spark.createDataFrame([(0.0,), (1.0,), (0.0,), (1.0,), (1.0,)], "y double")
    real = spark.createDataFrame([(1.5,), (2.7,), (3.2,), (4.1,), (5.9,)], "y double")
    assert profile.infer_task(few, "y") == "classification"
    assert profile.infer_task(real, "y") == "regression"


def test_guards(spark):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        profile.require_rows(empty)
    with pytest.raises(ValueError, match="b"):
        profile.require_columns(empty, ["a", "b"])
    with pytest.raises(ValueError):
        prepare.fit_preparation(spark.createDataFrame(FX1, FX1_SCHEMA), "nothing", "regression")


def bayesian_ridge(x, y):
    """Reference fit on plain matrices."""
    n = len(y)
    xm, ym = x.mean(axis=0), y.mean()
    x, y = x - xm, y - ym
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    alpha, lam, old = 1.0 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        beta = vt.T @ ((u.T @ y) * s / (s**2 + lam / alpha))
        rest = ((y - x @ beta) ** 2).sum()
        gamma = (alpha * s**2 / (lam + alpha * s**2)).sum()
        lam = (gamma + 2e-6) / ((beta**2).sum() + 2e-6)
        alpha = (n - gamma + 2e-6) / (rest + 2e-6)
        if old is not None and np.abs(old - beta).sum() < 1e-3:
            break
        old = beta
    beta = vt.T @ ((u.T @ y) * s / (s**2 + lam / alpha))
    return beta, ym - xm @ beta


def iterative(x, rounds=10, tolerance=1e-3):
    missing = np.isnan(x)
    limit = tolerance * np.nanmax(np.abs(x))
    out = np.where(missing, np.nanmean(x, axis=0), x)
    order = [j for j in np.argsort(missing.sum(axis=0), kind="stable") if missing[:, j].any()]
    for _ in range(rounds):
        before = out.copy()
        for j in order:
            rest = [i for i in range(x.shape[1]) if i != j]
            seen = ~missing[:, j]
            beta, b = bayesian_ridge(out[seen][:, rest], out[seen, j])
            out[~seen, j] = out[~seen][:, rest] @ beta + b
        if np.abs(out - before).sum(axis=1).max() < limit:
            break
    return out


@pytest.mark.parametrize("p", [4, 18])
def test_iterative_imputation(spark, p):
    rng = np.random.default_rng(p)
    base = rng.normal(size=(300, 3))
    x = base @ rng.normal(size=(3, p)) + 0.3 * rng.normal(size=(300, p)) + 5
    gaps = rng.random(x.shape) < (0.15 if p == 4 else 0.02)
    gaps[:, 0] = False
    x[gaps] = np.nan
    names = [f"c{i}" for i in range(p)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    filled = impute.fit_iterative(df, names).transform(df).orderBy("id").collect()
    got = np.array([[r[n] for n in names] for r in filled])
    assert np.allclose(got, iterative(x), atol=1e-5)


def test_knn_imputation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in impute.knn_impute(df, ["a", "b", "c"], "id", 4, block_rows=13).collect()}
    for i in range(60):
        for c in range(3):
            if not np.isnan(x[i, c]):
                assert got[i][c] == x[i, c]
                continue
            options = []
            for d in range(60):
                both = ~np.isnan(x[i]) & ~np.isnan(x[d])
                if np.isnan(x[d, c]) or not both.any():
                    continue
                options.append((np.sqrt(((x[i] - x[d])[both] ** 2).sum() * 3 / both.sum()), d, x[d, c]))
            near = sorted(options)[:4]
            want = np.mean([v for _, _, v in near]) if near else np.nanmean(x[:, c])
            assert np.isclose(got[i][c], want)


def test_scalers_of_constant_columns(spark):
    df = spark.createDataFrame([(3.0, 0.0)] * 4, "a double, b double")
    for method in ("robust", "standard", "minmax", "maxabs"):
        fitted = scale.fit_scaler(df, ["a", "b"], method)
        assert all(v is not None for r in scale.apply_scaler(df, fitted).collect() for v in r)
    assert scale.apply_scaler(df, scale.fit_scaler(df, ["a"])).first()["a"] == 0.0


def test_power_transform(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=500) * 3 - 0.5
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    fitted = scale.fit_power(df, ["a"])
    lam = fitted["a"][0]

    def likelihood(g):
        up = np.log1p(np.abs(x)) if abs(g) < 1e-9 else ((np.abs(x) + 1) ** g - 1) / g
        down = -(((np.abs(x) + 1) ** (2 - g) - 1) / (2 - g))
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (g - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-2, 1.99, 4000)
    assert abs(lam - grid[np.argmax([likelihood(g) for g in grid])]) < 2e-3
    out = np.array([r["a"] for r in scale.apply_power(df, fitted).collect()])
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9


def test_power_grid_is_measured_in_batches(spark, monkeypatch):
    """Variances of both signs, large offsets, equal values and gaps; no expression per lambda, which made methods too long to compile."""
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=400) * 2, "b": rng.exponential(size=400) + 5e4, "c": np.full(400, 0.1), "d": -rng.exponential(size=400)}
    x["a"][:40] = np.nan
    cells = [F.get(F.array(*[F.lit(float(v)) for v in x[c]]), F.col("id").cast("int")).alias(c) for c in x]
    df = spark.range(400, numPartitions=5).select(*cells)
    calls, plain = [], scale.yeo_johnson
    monkeypatch.setattr(scale, "yeo_johnson", lambda *a: calls.append(a) or plain(*a))
    scale.fit_power(df, ["a", "c"], rounds=2)
    assert len(calls) == 2
    grid = np.array([-2.0, 0.0, 0.7, 1.0, 2.0, 4.0])
    found = scale._grid_moments(df.replace(float("nan"), None), {c: grid for c in x})
    assert len(found) == len(x) * len(grid)
    for i, c in enumerate(x):
        v = x[c][~np.isnan(x[c])]
        for j, g in enumerate(grid):
            up = np.log1p(np.abs(v)) if g == 0 else ((np.abs(v) + 1) ** g - 1) / g
            down = -np.log1p(np.abs(v)) if g == 2 else -((np.abs(v) + 1) ** (2 - g) - 1) / (2 - g)
            variance, logs = found[i, j]
            want = np.where(v >= 0, up, down).var() if c != "c" else 0.0
            # Far from 0 a negative power loses digits to the one that is taken off.
            assert np.isclose(variance, want, rtol=1e-3 if c == "b" and g < 0 else 1e-9) or (c == "b" and g < 0 and variance < 1e-12)
            assert np.isclose(logs, (np.sign(v) * np.log1p(np.abs(v))).mean(), rtol=1e-12)


@pytest.mark.parametrize("p", [3, 20])
def test_pack_sums(spark, p):
    rng = np.random.default_rng(p)
    x, g = rng.normal(size=(200, p)), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(g, x)], "g int, a array<double>").repartition(4)
    for k, (n, total, cross) in pack_sums(df, "g", "a", np.ones(p)).items():
        part = x[g == k] - 1
        assert n == len(part) and np.allclose(total, part.sum(axis=0)) and np.allclose(cross, part.T @ part)


def test_label_codes_follow_the_number_order(spark):
    df = spark.createDataFrame([(10.0,), (2.0,), (1.0,), (10.0,)], "y double")
    got = {(r["y"], r["code"]) for r in encode.label_encode(df, "y", output="code").collect()}
    assert got == {(1.0, 0.0), (2.0, 1.0), (10.0, 2.0)}


def test_too_many_categories_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encode.categories(df, ["c"], limit=10)


def test_f_and_chi_square_tails():
    from modelyard.functions.stats import chi_square_tail, f_tail

    assert abs(chi_square_tail(5.991464547, 2) - 0.05) < 1e-9
    assert abs(chi_square_tail(18.307038053, 10) - 0.05) < 1e-9
    assert abs(f_tail(4.964602744, 1, 10) - 0.05) < 1e-9
    assert abs(f_tail(2.866081402, 4, 20) - 0.05) < 1e-8


def test_elimination_order():
    weight = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 0.5}
    assert select.eliminate(list(weight), lambda names: weight, keep=2) == [("a", 1), ("c", 1), ("b", 2), ("d", 3)]


def test_splits(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    train, test = split.train_test_split(df, ["id"])
    assert train.count() + test.count() == 4000 and 700 < test.count() < 900
    again = split.train_test_split(df.repartition(7), ["id"])[1]
    assert again.exceptAll(test).isEmpty()
    train, test = split.stratified_split(df, "y", "id")
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {0: 720, 1: 80}
    assert train.join(test, "id").isEmpty()


def test_trees_draw_by_themselves_from_many_rows(spark):
    trees, sample, seed = 5, 8, 3
    x = np.random.default_rng(0).normal(size=(3000, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    fitted = outliers.fit_isolation_trees(df, "features", "id", trees=trees, sample=sample, seed=seed)
    drawn = df.select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    found = drawn.select("key", "tree", split.draw(["key", "tree"], seed).alias("u")).toPandas()
    for tree in range(trees):
        rows = found[found["tree"] == tree].nsmallest(sample, "u")["key"].to_numpy()
        nodes = outliers._grow(x[rows], np.random.default_rng([seed, tree]), 3)
        assert np.allclose(fitted["forest"][tree]["cut"], [n[1] for n in nodes])


def test_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    x[:10] += 12
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    out = outliers.flag_outliers(df, "features", "id", contamination=0.02, trees=30)
    flagged = {r["id"] for r in out.where("is_outlier").collect()}
    assert flagged == set(range(10))
    assert out.agg(F.min("outlier_score") > 0, F.max("outlier_score") <= 1).first() == (True, True)
    # Many rows, few of them drawn: one draw per row.
    fitted = outliers.fit_isolation_trees(df, "features", "id", trees=5, sample=8)
    assert len(fitted["forest"]) == 5 and fitted["rows"] == 8
