"""Largest eigenvalues of a sparse symmetric matrix whose entries are rows of a table, and spectral clusters from them.

A block of vectors is improved by Rayleigh-Ritz steps on three blocks: the vectors, their residuals, and the last change. The rows of the
matrix are dealt into parts. The vectors of a part, and the entries between two parts, are packed once, one row of bytes each, as there are many
steps and joining single entries would be most of their time. A step is one product of the entries with the residuals, in which a part
sends another one sum per row that it touches, and two tables of (3 b)^2 inner products, which are all that reaches the driver. Steps
end when every wanted residual is below the tolerance, which bounds the error of its eigenvalue.
"""

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from modelyard import settings
from modelyard.operators.metric_index import BLOCK_ROWS, CELL_ROWS, stacked
from modelyard.operators.neighbours import nearest
from modelyard.session import cut_lineage

# Least and most rows of a part; between them there are 16 parts.
PART_ROWS = 5_000, 50_000
BLOCKS = ("x", "r", "p", "ax", "ar", "ap")
STATE = "part int, " + ", ".join(f"{c} binary" for c in BLOCKS)
ENTRIES = "a int, b int, rows binary, starts binary, columns binary, weights binary"


def packed_entries(entries: DataFrame, numbered: DataFrame) -> DataFrame:
    """The entries (a, b, weight) between two parts as one row of bytes: the rows they touch, where each begins, columns and weights."""
    end = lambda c: numbered.select(F.col("key").alias(c), F.col("part").alias(f"_{c}"), F.col("place").alias(f"{c}_place"))
    met = entries.join(end("a"), "a").join(end("b"), "b").select("_a", "_b", "a_place", "b_place", F.col("weight").cast("double").alias("weight"))

    def pack(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["a_place", "b_place"], kind="stable")
        rows, starts = np.unique(found["a_place"].to_numpy(dtype=np.int64), return_index=True)
        columns, weights = found["b_place"].to_numpy(dtype=np.int64), found["weight"].to_numpy(dtype=float)
        names = [column.split()[0] for column in ENTRIES.split(", ")]
        return pd.DataFrame([[found["_a"].iloc[0], found["_b"].iloc[0], *(v.tobytes() for v in (rows, starts.astype(np.int64), columns, weights))]], columns=names)

    return met.groupBy("_a", "_b").applyInPandas(pack, ENTRIES)


def product(entries: pd.DataFrame, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of packed entries of one part of columns: the part, the rows and their sums, with the vectors of the columns."""
    for e in entries.sort_values("a").to_dict("records"):
        rows, starts, columns = (np.frombuffer(e[c], np.int64) for c in ("rows", "starts", "columns"))
        yield e["a"], rows, np.add.reduceat(np.frombuffer(e["weights"])[:, None] * vectors[columns], starts, axis=0)


def inner_products(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables of inner products of the three blocks with each other, and with their products with the matrix."""

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 3 * width, 3 * width))
        for batch in batches:
            for row in batch.to_dict("records"):
                basis, applied = _sides(row, width)
                total += np.stack([basis.T @ basis, basis.T @ applied])
        yield pd.DataFrame({"v": [total.tobytes()]})

    found = state.mapInPandas(partial, "v binary").collect()
    return tuple(sum(np.frombuffer(r["v"]) for r in found).reshape(2, 3 * width, 3 * width))


def _sides(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The three blocks of a part side by side, and their products with the matrix."""
    x, r, p, ax, ar, ap = (np.frombuffer(row[c]).reshape(-1, width) for c in BLOCKS)
    return np.hstack([x, r, p]), np.hstack([ax, ar, ap])


def top_eigenvectors(
    entries: DataFrame, nodes: DataFrame, k: int, tolerance: float = 1e-6, most_steps: int = 200, seed: int = settings.RANDOM_STATE
) -> tuple[np.ndarray, DataFrame]:
    """The `k` largest eigenvalues, falling, and `key, x`: the entries of their unit eigenvectors.

    `entries` (a, b, weight) holds both (a, b) and (b, a). `nodes` has every `key` once. With fewer nodes than `k` there are as many values
    as nodes. Vectors that have not settled after `most_steps` are an error.
    """
    width = k + max(2, k // 2)
    n = nodes.count()
    parts = max(1, ceil(n / min(PART_ROWS[1], max(PART_ROWS[0], ceil(n / 16)))))
    part = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(parts)).cast("int")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    numbered = cut_lineage(nodes.select("key", part.alias("part")).withColumn("place", place))
    packed = cut_lineage(packed_entries(entries, numbered))
    start = [F.xxhash64(F.lit(seed), F.lit(j), F.col("key").cast("string")) / F.lit(2.0**63) for j in range(width)]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        x = stacked(rows.sort_values("place")["x"])
        return _state(rows["part"].iloc[0], [x] + [np.zeros_like(x)] * 5)

    state = numbered.withColumn("x", F.array(*start)).groupBy("part").applyInPandas(first, STATE)
    state = cut_lineage(_with_product(packed, cut_lineage(state), "x", lambda row: _sides(row, width), width))
    values = None
    for _ in range(most_steps):
        gram, applied = inner_products(state, width)
        if values is not None and (np.sqrt(np.diag(gram)[width : width + k]) <= tolerance).all():
            return values[: min(k, len(values))], _unpacked(state, numbered, k, width)
        weights, found = _ritz(gram, (applied + applied.T) / 2, width)
        values = np.zeros(width)
        values[: len(found)] = found
        state = cut_lineage(_with_product(packed, state, "r", _moved(weights, values, width), width))
    raise ArithmeticError("the eigenvectors did not settle")


def _state(part: int, blocks: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([[part, *(v.tobytes() for v in blocks)]], columns=["part", *BLOCKS])


def _with_product(packed: DataFrame, state: DataFrame, name: str, moved, width: int) -> DataFrame:
    """The state after `moved`, with the product of the matrix and its block `name`."""
    at = BLOCKS.index(name)

    def sums(both: pd.DataFrame) -> pd.DataFrame:
        entries, rows = both[both["a"].notna()], both[both["a"].isna()]
        out = []
        for row in rows.to_dict("records") if len(entries) else []:
            vectors = np.split(moved(row)[0], 3, axis=1)[at]
            out += [(int(part), row["part"], touched.tobytes(), y.tobytes()) for part, touched, y in product(entries, vectors)]
        return pd.DataFrame(out, columns=["part", "source", "rows", "y"])

    def added(both: pd.DataFrame) -> pd.DataFrame:
        row = both[both["source"].isna()].to_dict("records")[0]
        basis, applied = moved(row)
        y = np.zeros((len(basis), width))
        for found in both[both["source"].notna()].sort_values("source").to_dict("records"):
            y[np.frombuffer(found["rows"], np.int64)] += np.frombuffer(found["y"]).reshape(-1, width)
        blocks = np.split(basis, 3, axis=1) + np.split(applied, 3, axis=1)
        blocks[3 + at] = y
        return _state(row["part"], blocks)

    # Unions, as Spark takes a join or cogroup to be as large as the product of its sides: kept from step to step, that number grows
    # to millions of digits.
    sent = packed.withColumnRenamed("b", "part").unionByName(state, allowMissingColumns=True)
    sent = sent.groupBy("part").applyInPandas(sums, "part int, source int, rows binary, y binary")
    return state.unionByName(sent, allowMissingColumns=True).groupBy("part").applyInPandas(added, STATE)


def _unpacked(state: DataFrame, numbered: DataFrame, k: int, width: int) -> DataFrame:
    """`key, x`: the first `k` vectors by row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, x in zip(batch["part"], batch["x"]):
                x = np.frombuffer(x).reshape(-1, width)[:, :k]
                for i in range(0, len(x), 10_000):
                    yield pd.DataFrame({"part": part, "place": np.arange(i, min(i + 10_000, len(x))), "x": list(x[i : i + 10_000])})

    found = state.select("part", "x").mapInPandas(run, "part int, place int, x array<double>")
    return numbered.join(found, ["part", "place"]).select("key", "x")


def _ritz(gram: np.ndarray, applied: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the basis that give the best vectors in it, and their values; directions lost in rounding are left out."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    scale = np.where(np.diag(gram) > 0, scale, 1.0)
    sizes, turned = np.linalg.eigh(gram / scale[:, None] / scale[None, :])
    kept = sizes > 1e-11 * max(sizes.max(), 1e-300)
    basis = turned[:, kept] / np.sqrt(sizes[kept]) / scale[:, None]
    values, vectors = np.linalg.eigh(basis.T @ applied @ basis)
    order = np.argsort(-values)[:width]
    weights = np.zeros((len(gram), width))
    weights[:, : len(order)] = basis @ vectors[:, order]
    return weights, values[order]


def _moved(weights: np.ndarray, values: np.ndarray, width: int):
    """The next blocks of a part: new vectors, their residuals, and the part of the change that is not from the old ones."""
    change = weights.copy()
    change[:width] = 0.0

    def run(row: dict) -> tuple[np.ndarray, np.ndarray]:
        basis, applied = _sides(row, width)
        x, ax, p, ap = basis @ weights, applied @ weights, basis @ change, applied @ change
        return np.hstack([x, ax - x * values, p]), np.hstack([ax, np.zeros_like(x), ap])

    return run


def neighbour_graph(df: DataFrame, key: str, n_neighbors: int, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b, weight) in both directions: the nearest neighbours, weighted by a Gaussian of the distance, over the root of both degrees."""
    rows = df.select(F.col(key).alias("key"), "features", F.lit(0.0).alias("label"))
    near = cut_lineage(nearest(rows, rows, n_neighbors, skip_self=True, block_rows=block_rows, cell_rows=cell_rows))
    width = near.agg(F.avg(F.col("gap") * F.col("gap"))).first()[0] or 0.0
    weight = F.exp(-F.col("gap") * F.col("gap") / F.lit(max(width, 1e-300)))
    half = near.select(F.col("key").alias("a"), F.col("donor").alias("b"), (weight / 2).alias("weight"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    entries = cut_lineage(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    degrees = cut_lineage(entries.groupBy("a").agg(F.sum("weight").alias("degree")))
    end = lambda c: degrees.select(F.col("a").alias(c), F.col("degree").alias(f"_{c}"))
    scaled = entries.join(end("a"), "a").join(end("b"), "b")
    return cut_lineage(scaled.select("a", "b", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("weight")))


def spectral(
    df: DataFrame, key: str, n_clusters: int = 8, n_neighbors: int = 10, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
    tolerance: float = 1e-4, seed: int = settings.RANDOM_STATE,
) -> DataFrame:
    """(key, cluster): k-means on the rows of the leading eigenvectors of the normalised neighbour graph, each row scaled to length one.

    Rows without a neighbour, such as those with missing features, are in no cluster: -1.
    """
    entries = neighbour_graph(df, key, n_neighbors, block_rows, cell_rows)
    nodes = entries.select(F.col("a").alias("key")).distinct()
    if nodes.isEmpty():
        return df.select(F.col(key), F.lit(-1).alias("cluster"))
    _, vectors = top_eigenvectors(entries, nodes, n_clusters, tolerance, seed=seed)
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select("key", array_to_vector(F.transform("x", lambda v: v / F.greatest(size, F.lit(1e-300)))).alias("features"))
    # The start of k-means depends on the places of the rows: these are by key, however many parts there were.
    rows = cut_lineage(rows.repartition("key").sortWithinPartitions("key"))
    found = KMeans(k=n_clusters, seed=seed, maxIter=100).fit(rows).transform(rows).select(F.col("key").alias(key), "prediction")
    return df.select(F.col(key)).join(found, key, "left").select(key, F.coalesce("prediction", F.lit(-1)).cast("int").alias("cluster"))
