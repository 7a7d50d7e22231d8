"""Cluster metrics from a table with a vector column and a cluster column."""

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import as_array, as_vector, squared_distance
from modelyard.operators.pairs import BLOCK_ROWS, block_count, grid, matrix, summed_distances


def _moments(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """One row per cluster: size, mean vector and sum of squares around the mean, from one map-side aggregate."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v"))
    found = df.select(F.col(cluster).alias("cluster"), as_vector(df, features).alias("_v")).groupBy("cluster").agg(
        summary.alias("s")
    )
    size = F.col("s.count").cast("long")
    return found.select(
        "cluster",
        size.alias("size"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"), lambda v: F.when(size > 1, v * (size - 1)).otherwise(F.lit(0.0))
        ).alias("squares"),
    )


def _to_centre(df: DataFrame, features: str, cluster: str, moments: DataFrame) -> DataFrame:
    """Mean distance of the members of a cluster to its mean."""
    points = df.select(F.col(cluster).alias("cluster"), as_array(df, features).alias("x"))
    return (
        points.join(moments.select("cluster", "mean"), "cluster")
        .groupBy("cluster")
        .agg(F.avg(F.sqrt(squared_distance(F.col("x"), F.col("mean")))).alias("density"))
    )


def cluster_stats(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Size and mean distance to the centre ("density") of every cluster."""
    moments = _moments(df, features, cluster)
    return moments.select("cluster", "size").join(_to_centre(df, features, cluster, moments), "cluster")


def cluster_moments(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean and population deviation of every cluster and dimension, long form."""
    return (
        _moments(df, features, cluster)
        .select("cluster", "size", F.posexplode(F.arrays_zip("mean", "squares")).alias("dim", "m"))
        .select(
            "cluster",
            F.col("dim").cast("long").alias("dim"),
            F.col("m.mean").alias("mean"),
            F.sqrt(F.col("m.squares") / F.col("size")).alias("std"),
        )
    )


def calinski_harabasz(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    cells = _moments(df, features, cluster).select(
        "cluster", "size", F.posexplode(F.arrays_zip("mean", "squares")).alias("dim", "m")
    )
    size, mean = F.col("size"), F.col("m.mean")
    dims = cells.groupBy("dim").agg(
        F.sum("m.squares").alias("within"),
        F.sum(size).alias("n"),
        F.count("*").alias("k"),
        # Weighted spread of the cluster means around the overall mean, from centred second moments.
        (F.sum(size * mean * mean) - F.sum(size * mean) * F.sum(size * mean) / F.sum(size)).alias("between"),
    )
    k, n = F.max("k"), F.max("n")
    value = F.try_divide(F.try_divide(F.sum("between"), k - 1), F.try_divide(F.sum("within"), n - k))
    return dims.agg(F.when(F.sum("within") > 0, value).otherwise(1.0).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance.

    The cluster summary (one row per cluster) is compared on the driver, one cluster against the others at a time.
    """
    moments = _moments(df, features, cluster)
    rows = moments.join(_to_centre(df, features, cluster, moments), "cluster").collect()
    centres = np.array([r["mean"] for r in rows])
    spread = np.array([r["density"] for r in rows])
    worst = []
    for i in range(len(rows)):
        gap = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, (spread + spread[i]) / gap, 0.0)
        worst.append(ratio.max())
    value = float(np.mean(worst)) if len(rows) > 1 else float("nan")
    return df.sparkSession.createDataFrame([(value,)], "davies_bouldin double")


def silhouette(df: DataFrame, features: str, cluster: str, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette, mean over all rows; 0 for a cluster of one.

    The work is quadratic by definition. Distances are summed per (row, cluster) inside each grid cell, so no pair
    leaves a task. For tables where quadratic work is out of reach use `silhouette_squared`.
    """
    points = df.select(
        F.col(key).alias("key"), F.col(cluster).cast("string").alias("cluster"), as_array(df, features).alias("features")
    )
    blocks = block_count(points.count(), block_rows)
    key_type = df.schema[key].dataType.simpleString()

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "own": [], "other": [], "total": [], "n": []})
        names, codes = np.unique(b["cluster"].to_numpy(dtype=str), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(names)))
        totals = summed_distances(matrix(a), matrix(b)[order], starts)
        counts = np.diff(np.r_[starts, len(b)])
        return pd.DataFrame(
            {
                "key": np.repeat(a["key"].to_numpy(), len(names)),
                "own": np.repeat(a["cluster"].to_numpy(), len(names)),
                "other": np.tile(names, len(a)),
                "total": totals.ravel(),
                "n": np.tile(counts, len(a)),
            }
        )

    cells = grid(points, points, blocks, blocks, sums, f"key {key_type}, own string, other string, total double, n long")
    per_row = cells.groupBy("key", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    is_own = F.col("own") == F.col("other")
    scored = per_row.groupBy("key").agg(
        F.max(F.when(is_own, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return scored.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


def silhouette_squared(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Silhouette with squared Euclidean distance: linear work, a value of its own next to `silhouette`.

    Cluster names are numbered first, as the evaluator wants numeric ones.
    """
    from pyspark.ml.feature import StringIndexer

    rows = df.select(F.col(cluster).cast("string").alias("name"), as_vector(df, features).alias("features"))
    numbered = StringIndexer(inputCol="name", outputCol="prediction").fit(rows).transform(rows)
    value = ClusteringEvaluator(metricName="silhouette").evaluate(numbered)
    return df.sparkSession.createDataFrame([(value,)], "silhouette_squared double")


def evaluate_clustering(df: DataFrame, features: str, cluster: str, key: str, shape: str = "silhouette") -> DataFrame:
    """The named silhouette and both dispersion scores; `shape` is `silhouette` (quadratic work) or `silhouette_squared` (linear)."""
    if shape not in ("silhouette", "silhouette_squared"):
        raise ValueError(f"unknown silhouette: {shape}")
    first = silhouette(df, features, cluster, key) if shape == "silhouette" else silhouette_squared(df, features, cluster)
    out = None
    for table in (first, calinski_harabasz(df, features, cluster), davies_bouldin(df, features, cluster)):
        name = table.columns[0]
        part = table.select(F.lit(name).alias("metric"), F.col(name).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
