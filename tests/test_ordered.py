import numpy as np
import pytest
from pyspark.sql import functions as F

from modelyard.operators.ordered import exact_percentiles, row_rank, running_max, running_totals, trailing, with_previous


def table(spark, n=2000, seed=0, groups=3):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.4
    group = np.where(hot, 0, rng.integers(1, groups, n))
    value = rng.permutation(n).astype(float)
    rows = [(int(i), int(g), float(v), int(a)) for i, (g, v, a) in enumerate(zip(group, value, rng.integers(0, 9, n)))]
    return rows, spark.createDataFrame(rows, "id long, g long, v double, a long").repartition(5)


@pytest.mark.parametrize("ranges", [2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, ranges, descending):
    rows, df = table(spark)
    got = {
        r["id"]: (r["cum_a"], r["next_a"])
        for r in running_totals(df, "v", ["a"], ["g"], descending, ranges, look_ahead=True).collect()
    }
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: r[2], reverse=descending)
        total = 0
        for i, r in enumerate(own):
            total += r[3]
            following = own[i + 1][3] if i + 1 < len(own) else None
            assert got[r[0]] == (total, following)


@pytest.mark.parametrize("ranges", [2, 33])
def test_previous_and_rank(spark, ranges):
    rows, df = table(spark, seed=1)
    previous = {r["id"]: r["prev_a"] for r in with_previous(df, ["a"], "v", ["g"], ranges=ranges).collect()}
    rank = {r["id"]: r["row_rank"] for r in row_rank(df, "v", ["g"], ranges).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: r[2])
        for i, r in enumerate(own):
            assert previous[r[0]] == (own[i - 1][3] if i else None)
            assert rank[r[0]] == i + 1


def test_running_max_and_trailing(spark):
    rows, df = table(spark, seed=2)
    best = {r["id"]: r["best"] for r in running_max(df, "a", "v", ["g"]).collect()}
    last = {r["id"]: r["s"] for r in trailing(df, "v", ["g"], 4, {"s": F.sum("a")}, block_rows=10).collect()}
    assert len(last) == len(rows)
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: r[2])
        for i, r in enumerate(own):
            assert best[r[0]] == max(x[3] for x in own[: i + 1])
            assert last[r[0]] == sum(x[3] for x in own[max(0, i - 3) : i + 1])


@pytest.mark.parametrize("limit", [100_000, 50, 3])
def test_exact_percentiles(spark, limit):
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=3000)
    # A third of the rows share one value.
    hot = np.where(rng.random(3000) < 0.34, 5.0, rng.normal(5, 3, 3000))
    few = rng.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(smooth, hot, few)], "a double, b double, c double")
    at = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_percentiles(df.repartition(4), ["a", "b", "c"], at, final_rows=limit)
    for name, values in (("a", smooth), ("b", hot), ("c", few)):
        assert np.allclose(got[name], np.percentile(values, [p * 100 for p in at]))


def test_percentiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert exact_percentiles(df, ["a"], [0.5]) == {"a": [None]}
