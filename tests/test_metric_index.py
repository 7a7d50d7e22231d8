"""The metric index and what is built on it, against plain versions that compare all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_models import brute_dbscan

from modelyard.operators import impute, metric_index, partitioning, spectrum
from modelyard.operators.models import estimator, model_names
from modelyard.operators.pairs import distances
from modelyard.operators.neighbours import first_visits, later_visits, nearest
from modelyard.plans.pipelines import train
from modelyard.sources.store import Store, read_model, write_model

RNG = np.random.default_rng(11)


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], float(0 if labels is None else labels[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, features array<double>, label double").repartition(5)


def uneven(n=300):
    """Clusters, lone rows, and a third of all rows equal."""
    x = np.vstack([RNG.normal(size=(n // 3, 3)) * 0.2 + c for c in ((0, 0, 0), (5, 1, 0))])
    return np.vstack([x, np.tile([[2.0, 2.0, 2.0]], (n // 3, 1)), RNG.uniform(-9, 9, size=(n // 10, 3))])


def gaps_of(x):
    return distances(x, x)


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(7, 5), (1000, 4000)])
def test_nearest_of_uneven_rows(spark, cell_rows, block_rows):
    x = uneven()
    gaps = gaps_of(x)
    df = frame(spark, x)
    found = nearest(df, df, 4, skip_self=True, cell_rows=cell_rows, block_rows=block_rows).collect()
    got = {}
    for r in found:
        got.setdefault(r["key"], []).append((r["gap"], r["donor"]))
    for i in range(len(x)):
        row = gaps[i].copy()
        row[i] = np.inf
        assert sorted(got[i]) == [(row[j], j) for j in np.lexsort((np.arange(len(x)), row))[:4]]


def test_rows_without_a_place_find_and_are_nothing(spark):
    rows = [(1, [0.0, 0.0], 1.0), (2, [1.0, 0.0], 2.0), (3, [float("nan"), 0.0], 3.0), (4, None, 4.0), (5, [float("inf"), 0.0], 5.0)]
    df = spark.createDataFrame(rows, "key long, features array<double>, label double")
    found = nearest(df.where("key <> 4"), df, 3)
    assert sorted((r["key"], r["donor"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert nearest(df.where("key < 3"), df.where("key > 9"), 2).count() == 0
    assert nearest(df.where("key > 9"), df, 2).count() == 0


def test_most_rings_are_skipped(spark):
    """100,000 rows in 300 clusters: a row meets few of the rings, and no block is large."""
    rng = np.random.default_rng(2)
    centres = rng.uniform(-100, 100, size=(300, 3))
    columns = [F.element_at(F.array(*[F.lit(float(v)) for v in centres[:, d]]), F.col("c") + 1) + F.randn(d) for d in range(3)]
    df = spark.range(100_000, numPartitions=8).withColumn("c", F.pmod(F.xxhash64("id"), F.lit(300)).cast("int"))
    df = df.select(F.col("id").alias("key"), F.array(*columns).alias("features"), F.lit(0.0).alias("label"))
    df = partitioning.cut_lineage(df)
    index = metric_index.build(df)
    queries = df.select("key", "features")
    first = first_visits(queries, index, 6)
    # A reach that covers the nearest five in such a cluster.
    later = later_visits(queries.withColumn("reach", F.lit(2.0)), index, 6)
    pairs = 100_000 * len(index.rings)
    assert (first.count() + later.count()) / pairs < 0.1
    assert index.rings.rows.sum() == 100_000
    found = nearest(df, df, 5, skip_self=True)
    assert found.count() == 500_000 and found.agg(F.max("gap")).first()[0] < 6


def test_hot_rings_are_dealt(spark):
    """Equal rows are one ring; both sides of its meeting are cut."""
    df = frame(spark, np.tile([[1.0, 2.0]], (90, 1)))
    index = metric_index.build(df, 10, 20)
    assert len(index.rings) == 1
    measured = lambda a, b: pd.DataFrame({"a": [len(a)], "b": [len(b)]})
    sizes = metric_index.meet(df.withColumn("ring", F.lit(0)), index.rows, measured, "a long, b long", 20).collect()
    assert len(sizes) == 25 and sum(r["a"] * r["b"] for r in sizes) == 90 * 90 and max(r["a"] for r in sizes) < 45


@pytest.mark.parametrize("cell_rows", [6, 1000])
def test_knn_imputation_of_many_patterns(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(impute, "PATTERNS", 3)
    p, k = 4, 3
    x = RNG.normal(size=(120, p)).round(1)
    x[RNG.random(x.shape) < 0.25] = np.nan
    x[5] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(3)
    got = {r["id"]: [r[n] for n in "abcd"] for r in impute.knn_impute(df, list("abcd"), "id", k, block_rows=9, cell_rows=cell_rows).collect()}
    for i in range(len(x)):
        shared = ~np.isnan(x) & ~np.isnan(x[i])
        width = shared.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(width > 0, np.sqrt(np.where(shared, (x - x[i]) ** 2, 0).sum(1) * p / width), np.inf)
        for c in range(p):
            want = x[i, c]
            if np.isnan(want):
                able = np.flatnonzero(~np.isnan(x[:, c]) & np.isfinite(gap))
                best = able[np.lexsort((able, gap[able]))[:k]]
                want = x[best, c].mean() if len(best) else np.nanmean(x[:, c])
            assert abs(got[i][c] - want) < 1e-12


def test_pairs_of_knn_imputation_grow_with_the_rows(spark, monkeypatch):
    """Few different values in one column, only different ones in the other: neither pattern meets a share of the table."""
    met, meet = [], metric_index.meet

    def counted(visitors, rows, *rest):
        visitors = partitioning.cut_lineage(visitors)
        pairs = visitors.groupBy("ring").count().join(rows.groupBy("ring").agg(F.count(F.lit(1)).alias("n")), "ring")
        met.append(pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0)
        return meet(visitors, rows, *rest)

    monkeypatch.setattr(metric_index, "meet", counted)
    totals = []
    for n in (3000, 12_000):
        a = F.when(F.col("id") % 9 != 0, F.pmod(F.xxhash64("id"), F.lit(10)).cast("double"))
        b = F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_003)) / 1_000_003)
        df = partitioning.cut_lineage(spark.range(n, numPartitions=4).select("id", a.alias("a"), b.alias("b")))
        met.clear()
        assert impute.knn_impute(df, ["a", "b"], "id", cell_rows=20).where("a IS NULL OR b IS NULL").count() == 0
        totals.append(sum(met))
    assert totals[1] < 7 * totals[0] and totals[1] < 100 * n


def test_knn_imputation_of_repeated_and_missing_keys(spark):
    """Rows of a key share what they find, donors without a key come last of equally near ones, rows without one take the mean."""
    rows = [(None, 1.0, 50.0), (7, 1.0, 10.0), (7, 1.0, 10.0), (3, 1.0, 30.0), (9, 4.0, 90.0), (1, 1.0, None), (2, 4.0, None), (2, 1.0, None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    found = sorted((r["id"] or 0, r["a"], r["b"]) for r in impute.knn_impute(df, ["a", "b"], "id", 2).collect())
    filled = [(0, 1.0, 38.0), (1, 1.0, 20.0), (2, 1.0, 20.0), (2, 4.0, 20.0)]
    assert found == sorted([(key or 0, a, b) for key, a, b in rows if b is not None] + filled)
    words = df.withColumn("id", F.col("id").cast("string"))
    found = {(r["id"], r["a"], r["b"]) for r in impute.knn_impute(words, ["a", "b"], "id", 4).collect()}
    assert ("1", 1.0, 25.0) in found


@pytest.mark.parametrize("eps", [0.0, 0.3, 1.0])
def test_density_clusters_of_uneven_rows(spark, eps):
    x = uneven(150)
    got = {r["key"]: r["cluster"] for r in partitioning.dbscan(frame(spark, x), "key", eps, 4, block_rows=11, cell_rows=9).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, 4).tolist()


def plain_tree(x):
    """Edges (gap, a, b) of the least spanning tree, grown from row 0."""
    gaps, edges, inside = gaps_of(x), [], {0}
    while len(inside) < len(x):
        best = min((gaps[i, j], min(i, j), max(i, j)) for i in inside for j in range(len(x)) if j not in inside)
        edges.append(best)
        inside |= set(best[1:])
    return sorted(edges)


def plain_cut(edges, n, k):
    name = list(range(n))
    for _, a, b in edges[: len(edges) - (k - 1)]:
        low, high = sorted((name[a], name[b]))
        name = [low if v == high else v for v in name]
    return name


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(8, 6), (1000, 4000)])
def test_single_linkage_equals_the_plain_tree(spark, cell_rows, block_rows):
    x = uneven(60)
    want = plain_tree(x)
    tree = partitioning.single_linkage(frame(spark, x), "key", block_rows, cell_rows).collect()
    assert sorted((r["gap"], r["a"], r["b"]) for r in tree) == want
    cut = partitioning.agglomerative(frame(spark, x), "key", 5, block_rows, cell_rows).collect()
    assert [c for _, c in sorted((r["key"], r["cluster"]) for r in cut)] == plain_cut(want, len(x), 5)


def test_single_linkage_seldom_looks_beyond_its_lists(spark, monkeypatch):
    """Three groups, and equal rows: two passes over pairs make the lists, and few rows, never those of the largest component, look further."""
    x = np.vstack([np.random.default_rng(2).normal(size=(n, 3)) + c for n, c in ((60, 0), (30, 40), (20, 90))])
    x[5:25] = x[5]
    seen, asked = metric_index.tiles, []
    monkeypatch.setattr(metric_index, "tiles", lambda rows, *a, **k: asked.append(rows.count() if "comp" in rows.columns else 0) or seen(rows, *a, **k))
    tree = partitioning.single_linkage(frame(spark, x), "key", 20, 10).collect()
    assert sorted((r["gap"], r["a"], r["b"]) for r in tree) == plain_tree(x)
    assert asked[:2] == [0, 0] and max(asked) <= 91 - 41


def test_single_linkage_of_equal_rows_only(spark):
    tree = partitioning.single_linkage(frame(spark, np.ones((30, 2))), "key").collect()
    assert sorted((r["gap"], r["a"], r["b"]) for r in tree) == [(0.0, 0, i) for i in range(1, 30)]


def test_single_linkage_of_few_rows(spark):
    assert partitioning.single_linkage(frame(spark, np.zeros((1, 2))), "key").count() == 0
    assert partitioning.agglomerative(frame(spark, np.zeros((0, 2))), "key", 2).count() == 0
    both = partitioning.agglomerative(frame(spark, np.array([[0.0, 0.0], [1.0, 0.0]])), "key", 2).collect()
    assert sorted((r["key"], r["cluster"]) for r in both) == [(0, 0), (1, 1)]


@pytest.mark.parametrize(("name", "options"), [("dbscan", {"eps": 1.0, "min_samples": 4}), ("agglomerative", {"n_clusters": 2})])
def test_clusters_of_a_table_label_other_rows(spark, tmp_path, name, options):
    x = np.vstack([RNG.normal(size=(40, 2)) * 0.3 + c for c in ((0, 0), (6, 6))])
    df = frame(spark, x)
    model = estimator(name, "clustering", **options).fit(df)
    write_model(spark, model, str(tmp_path / "m"))
    for own in (model, read_model(spark, str(tmp_path / "m"))):
        got = {r["key"]: r["prediction"] for r in own.transform(df).collect()}
        assert len({got[i] for i in range(40)} - {-1}) == 1 and got[0] != got[41] and set(got.values()) <= {-1, 0, 1}
        far = own.transform(frame(spark, np.array([[6.1, 6.0], [90.0, 90.0]]))).orderBy("key").collect()
        assert [r["prediction"] for r in far] == [got[41], -1 if name == "dbscan" else got[41]]
    assert {"dbscan", "agglomerative", "spectral"} <= set(model_names("clustering"))


def test_training_reaches_density_clusters(spark, tmp_path):
    x = np.vstack([RNG.normal(size=(60, 2)) * 0.2 + c for c in ((0, 0), (3, 3))])
    df = spark.createDataFrame([(i, float(r[0]), float(r[1])) for i, r in enumerate(x)], "row_id long, a double, b double")
    out = train(Store(spark, str(tmp_path / "s")), df, None, "clustering", "groups", ["row_id"], F.lit("2024-01-01").cast("timestamp"),
                names=["dbscan"], n_trials=1, folds=2)
    assert out is not None


def test_eigenvalues_of_the_neighbour_graph(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(100, 3)) + c for c in ((0, 0, 0), (7, 0, 0), (0, 7, 0), (0, 0, 7), (4, 4, 4))])
    entries = spectrum.neighbour_graph(frame(spark, x), "key", 10)
    rows = entries.collect()
    dense = np.zeros((500, 500))
    for r in rows:
        dense[r["a"], r["b"]] = r["weight"]
    assert np.abs(dense - dense.T).max() < 1e-15
    want = np.linalg.eigvalsh(dense)[::-1][:5]
    values, vectors = spectrum.top_eigenvectors(entries, spark.range(500).select(F.col("id").alias("key")), 5)
    assert np.abs(values - want).max() < 1e-6
    u = np.array([r["x"] for r in vectors.orderBy("key").collect()])
    assert np.abs(dense @ u - u * values).max() < 1e-5 and np.abs(u.T @ u - np.eye(5)).max() < 1e-8


def test_a_product_has_a_row_of_bytes_per_two_parts(spark, monkeypatch):
    """The entries are packed once, and parts of the rows give the same values as all together."""
    rng = np.random.default_rng(4)
    dense = np.diag(np.r_[9.0, 7.0, 5.0, rng.uniform(0, 1, 57)])
    turn = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    dense = turn @ dense @ turn.T
    entries = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(60) for j in range(60)], "a long, b long, weight double")
    nodes = spark.range(60).toDF("key")
    monkeypatch.setattr(spectrum, "PART_ROWS", (4, 25))
    seen, made = spectrum.packed_entries, []
    monkeypatch.setattr(spectrum, "packed_entries", lambda *a: made.append(seen(*a)) or made[-1])
    values, vectors = spectrum.top_eigenvectors(entries, nodes, 3, 1e-5)
    assert np.abs(values - [9, 7, 5]).max() < 1e-6 and 1 < made[0].count() <= 225
    u = np.array([r["x"] for r in vectors.orderBy("key").collect()])
    assert np.abs(dense @ u - u * values).max() < 1e-4


def test_eigenvalues_of_a_matrix_smaller_than_the_block(spark):
    dense = np.array([[2.0, 1.0, 0.0], [1.0, 0.0, 0.5], [0.0, 0.5, -1.0]])
    rows = [(i, j, float(dense[i, j])) for i in range(3) for j in range(3)]
    values, _ = spectrum.top_eigenvectors(spark.createDataFrame(rows, "a long, b long, weight double"), spark.range(3).toDF("key"), 2)
    assert np.abs(values - np.linalg.eigvalsh(dense)[::-1][:2]).max() < 1e-9


def test_a_row_is_shipped_once_per_block(spark):
    """Rows without structure want every ring; a tile holds many rings, and no row comes to more tiles than there are blocks."""
    x = np.random.default_rng(5).normal(size=(600, 40))
    df = frame(spark, x)
    index = metric_index.build(df, 10, 50)
    assert len(index.rings) > 50
    rings = len(index.rings)
    every = lambda features, _: np.ones((len(features), rings), bool)
    measured = lambda a, b, masks: pd.DataFrame({"a": [len(a)], "b": [len(b)], "m": [int(masks(a)[:, b["ring"]].sum())]})
    found = metric_index.tiles(df.select("key", "features"), index, every, measured, "a long, b long, m long", 50).collect()
    assert sum(r["a"] * r["b"] for r in found) == sum(r["m"] for r in found) == 600 * 600
    assert len(found) < 12 * 12 and max(max(r["a"], r["b"]) for r in found) <= 200


def test_a_screen_loses_no_pair():
    for scale in (1e-9, 1.0, 1e12):
        x, y = RNG.normal(size=(80, 6)) * scale + 3, RNG.normal(size=(90, 6)) * scale + 3
        y[:20] = x[:20]
        gaps, rows = distances(x, y), np.arange(80)
        screen = metric_index.Screen(x, y)
        parts = screen.parts(rows, 0, 90)
        for limit in (0.0, float(np.median(gaps)), float(gaps[3, 40])):
            squared = np.full(80, limit * limit)
            assert (parts <= screen.above(rows, squared))[gaps <= limit].all()
            assert not (parts <= screen.below(rows, squared))[gaps > limit].any()
