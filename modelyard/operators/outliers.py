"""Outlier scores by random isolation trees."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from modelyard import settings
from modelyard.functions.vectors import as_array
from modelyard.operators.ordered import exact_percentiles
from modelyard.operators.split import draw

# Fixed value: Euler's constant, for the mean depth of an unsuccessful search.
EULER = 0.5772156649015329


def mean_depth(n):
    """Mean path length of a binary search tree with n entries."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, size); feature -1 marks a leaf."""
    nodes: list = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][2 if side == "l" else 3] = at
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append([f, cut, -1, -1, len(rows)])
        goes_left = part[:, f] <= cut
        todo += [(rows[goes_left], depth + 1, at, "l"), (rows[~goes_left], depth + 1, at, "r")]
    return [tuple(n) for n in nodes]


def fit_isolation_trees(
    df: DataFrame, features: str, key: str, trees: int = 100, sample: int = 256, seed: int = settings.RANDOM_STATE
) -> dict:
    """Grow every tree on its own sample of `sample` rows, one task per tree group.

    Each tree takes the rows with the smallest hash draws: a generous threshold first, then exactly `sample`.
    The forest (at most trees x 2 x sample nodes) is a parameter of the model and comes to the driver.
    """
    n = df.count()
    share = min(1.0, (2.0 * sample + 20.0) / max(1, n))
    rows = df.select(F.col(key).alias("key"), as_array(df, features).alias("x"))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    picked = drawn.withColumn("u", draw(["key", "tree"], seed)).where(F.col("u") < share).select("tree", "u", "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.nsmallest(sample, "u")
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(chosen["x"].to_numpy()).astype(float)
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "l", "r", "size"])
        return out.assign(tree=tree, node=range(len(out)), rows=len(x))

    found = picked.groupBy("tree").applyInPandas(
        grow, "feature int, cut double, l int, r int, size long, tree int, node int, rows long"
    )
    pdf = found.toPandas().sort_values(["tree", "node"])
    forest = [
        {c: part[c].to_numpy() for c in ("feature", "cut", "l", "r", "size")} for _, part in pdf.groupby("tree")
    ]
    return {"forest": forest, "rows": int(pdf["rows"].max()) if len(pdf) else 0}


def score_outliers(df: DataFrame, features: str, fitted: dict, output: str = "outlier_score") -> DataFrame:
    """Add the score in (0, 1]: 2 to the minus mean depth over expected depth."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fitted)

    def score(rows: pd.Series) -> pd.Series:
        model = shared.value
        x = np.stack(rows.to_numpy()).astype(float)
        depth = np.zeros(len(x))
        everyone = np.arange(len(x))
        for tree in model["forest"]:
            at = np.zeros(len(x), dtype=int)
            while True:
                feature = tree["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                who = everyone[inner]
                goes_left = x[who, feature[inner]] <= tree["cut"][at[inner]]
                at[who] = np.where(goes_left, tree["l"][at[inner]], tree["r"][at[inner]])
                depth[who] += 1
            depth += mean_depth(tree["size"][at])
        expected = float(mean_depth(model["rows"])) or 1.0
        return pd.Series(np.power(2.0, -depth / max(1, len(model["forest"])) / expected))

    return df.withColumn(output, pandas_udf(score, "double")(as_array(df, features)))


def flag_outliers(
    df: DataFrame, features: str, key: str, contamination: float = settings.CONTAMINATION, **options
) -> DataFrame:
    """Add score and flag: the share `contamination` of the rows with the highest scores."""
    scored = score_outliers(df, features, fit_isolation_trees(df, features, key, **options))
    cut = exact_percentiles(scored, ["outlier_score"], [1.0 - contamination])["outlier_score"][0]
    return scored.withColumn("is_outlier", F.col("outlier_score") > F.lit(cut))
