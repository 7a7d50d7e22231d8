"""Clusters beyond the built-in ones: mini-batch centres, density clusters, single linkage, and models of what they find."""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from modelyard import settings
from modelyard.functions.vectors import as_array
from modelyard.operators import metric_index
from modelyard.operators.metric_index import BLOCK_ROWS, CELL_ROWS, stacked
from modelyard.operators.neighbours import NearestNeighbours, nearest
from modelyard.operators.ordered import row_rank
from modelyard.operators.plain import PlainModel, linear_scores
from modelyard.operators.spectrum import spectral
from modelyard.operators.split import draw
from modelyard.session import cut_lineage


# Nearest rows that single linkage lists for each row, and most components that are merged on the driver.
LISTED, DRIVER_LINKS = 8, 100_000


class MiniBatchCentres(PlainModel):
    """Centres that move by a running mean over batches; `update` also takes a micro-batch of a stream."""

    state_names = ("centres", "counts")

    def __init__(self, n_clusters: int = 8, batch_rows: int = 1024, rounds: int = 20, seed: int = settings.RANDOM_STATE):
        self.n_clusters, self.batch_rows, self.rounds, self.seed = n_clusters, batch_rows, rounds, seed

    def fit(self, df: DataFrame) -> "MiniBatchCentres":
        """Every row moves a centre: a hash of the vector deals the table into batches, and each round takes the next one.

        A batch has about `batch_rows` rows, or more where `rounds` such batches are not the whole table. What rounds are
        left after all batches go over the table again, dealt anew.
        """
        x = as_array(df, "features")
        rows = df.select(x.alias("features"), F.xxhash64(x).alias("h"))
        n = rows.count()
        start = rows.orderBy(draw(["h"], self.seed)).limit(self.n_clusters).collect()
        self.centres = np.array([r["features"] for r in start])
        self.counts = np.zeros(len(self.centres))
        batches = max(1, min(self.rounds, -(-n // self.batch_rows)))
        for r in range(self.rounds):
            epoch, batch = divmod(r, batches)
            self.update(rows.where(F.floor(draw(["h"], self.seed + 1 + epoch) * batches) == batch))
            if batches == 1 and r:
                break
        return self

    def update(self, batch: DataFrame) -> None:
        """Move the centres by the sums of one batch: k rows come back, whatever its size."""
        assigned = self.transform(batch)
        p = self.centres.shape[1]
        x = as_array(assigned, "features")
        sums = assigned.groupBy("prediction").agg(
            F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(p)]
        )
        for row in sums.collect():
            c = int(row["prediction"])
            total = np.array([row[f"s{i}"] for i in range(p)])
            self.counts[c] += row["n"]
            self.centres[c] += (total - row["n"] * self.centres[c]) / self.counts[c]

    def transform(self, df: DataFrame) -> DataFrame:
        # The nearest centre has the largest x.c - |c|^2 / 2.
        centres = np.asarray(self.centres)
        scores = linear_scores(as_array(df, "features"), centres, -0.5 * (centres**2).sum(axis=1))
        place = F.array_position(F.col("_scores"), F.array_max("_scores")) - 1
        return df.withColumn("_scores", scores).withColumn("prediction", place.cast("int")).drop("_scores")


def dbscan(
    df: DataFrame, key: str, eps: float, min_samples: int = 5, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(key, cluster): density clusters, -1 for noise; a cluster is named by its smallest core key.

    Exact. Space is cut into cubes of side eps / sqrt(d), whose rows are all within eps of each other: a cube with `min_samples` rows is core
    at once, and core rows of a cube are one cluster, so components are sought over cubes and not over rows. Rows meet only the rings
    of a metric index that reach within eps. A border row goes to the cluster of its smallest core neighbour.
    """
    points = df.select(F.col(key).cast("long").alias("key"), as_array(df, "features").alias("features"))
    # A little smaller, so that rounding cannot put two rows of a cube farther apart than eps.
    side = F.lit(eps * (1 - 1e-9)) / F.sqrt(F.size("features"))
    place = F.transform("features", lambda v: F.floor(v / side).cast("string") if eps > 0 else v.cast("string"))
    points = points.withColumn("cube", F.md5(F.array_join(place, ",")))
    cubes = points.groupBy("cube").agg((F.count(F.lit(1)) >= min_samples).alias("full"))
    index = metric_index.build(points.join(cubes, "cube"), cell_rows, block_rows)
    rings = index.rings
    if not len(rings):
        return df.select(F.col(key), F.lit(-1).cast("long").alias("cluster"))
    reachable = lambda x, _: rings.bounds(x)[0] <= eps

    def count(a: pd.DataFrame, b: pd.DataFrame, masks) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "n": []})
        n = np.zeros(len(a), np.int64)
        b = b.iloc[np.argsort(b["ring"].to_numpy(), kind="stable")]
        for rows, parts, row, _ in close_pairs(a, b, masks, eps, listed=False):
            n[rows] += parts
            n += np.bincount(row, minlength=len(n))
        return pd.DataFrame({"key": a["key"].to_numpy(), "n": n})

    sparse = index.rows.where("NOT full").select("key", "features")
    found = metric_index.tiles(sparse, index, reachable, count, "key long, n long", block_rows, index.rows.select("key", "features", "ring"))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    marked = index.rows.join(counts, "key", "left").withColumn("core", F.col("full") | (F.coalesce("n", F.lit(0)) >= min_samples))
    marked = cut_lineage(marked.select("key", "features", "cube", "core", "ring"))
    core = marked.where("core").select("key", "features", "cube", "ring")

    def touch(a: pd.DataFrame, b: pd.DataFrame, masks) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "key": [], "near": []}, dtype=object)
        b = b.iloc[np.argsort(b["ring"].to_numpy(), kind="stable")]
        own, names = a["core"].to_numpy(dtype=bool), b["key"].to_numpy()
        cubes, code = np.unique(np.concatenate([a["cube"].to_numpy(), b["cube"].to_numpy()]).astype(str), return_inverse=True)
        none = np.iinfo(np.int64).max
        least, edges, waiting = np.full(len(a), none), [np.zeros((2, 0), np.int64)], 0
        for _, _, row, column in close_pairs(a, b, masks, eps):
            border = ~own[row]
            np.minimum.at(least, row[border], names[column[border]])
            edges.append(np.stack([code[row[~border]], code[len(a) + column[~border]]]))
            waiting += edges[-1].shape[1]
            if waiting > 2_000_000:
                edges, waiting = [forest(np.hstack(edges), len(cubes))], 0
        x, y = forest(np.hstack(edges), len(cubes))
        some = least < none
        # Edges of cubes; then border rows, with no edge.
        edge = pd.DataFrame({"a": cubes[x].astype(object), "b": cubes[y].astype(object), "key": 0, "near": 0})
        near = pd.DataFrame({"a": "", "b": "", "key": a["key"].to_numpy()[some], "near": least[some]})
        return pd.concat([edge, near]).astype({"a": object, "b": object, "key": np.int64, "near": np.int64})

    met = metric_index.tiles(marked.drop("ring"), index, reachable, touch, "a string, b string, key long, near long", block_rows, core)
    met = cut_lineage(met)
    nodes = core.groupBy("cube").agg(F.min("key").alias("least"))
    named = connected_components(nodes.select(F.col("cube").alias("key")), met.where("a <> b").select("a", "b")).withColumnRenamed("cluster", "component")
    named = nodes.join(named.withColumnRenamed("key", "cube"), "cube")
    first = named.groupBy("component").agg(F.min("least").alias("cluster"))
    named = cut_lineage(named.join(first, "component").select("cube", "cluster"))
    inner = core.select("key", "cube").join(named, "cube").select("key", "cluster")
    near = met.where("a = ''").groupBy("key").agg(F.min("near").alias("near"))
    outer = near.join(inner.withColumnRenamed("key", "near"), "near").select("key", "cluster")
    return df.select(F.col(key)).join(inner.unionByName(outer).withColumnRenamed("key", key), key, "left").select(
        key, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")
    )


def close_pairs(
    a: pd.DataFrame, b: pd.DataFrame, masks, eps: float, listed: bool = True
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By pieces of a tile: rows of `a` with the count of columns that are surely within `eps`, and the pairs (row, column) that are.

    Not `listed`, the sure ones are only counted, and the pairs are those that needed a look.
    """
    x, y = stacked(a["features"]), stacked(b["features"])
    squared = np.full(len(x), float(eps) * float(eps))
    for screen, rows, low, high in metric_index.screened(x, y, b["ring"].to_numpy(), masks(a)):
        parts = screen.parts(rows, low, high)
        near, sure = parts <= screen.above(rows, squared[rows]), parts <= screen.below(rows, squared[rows])
        row, column = np.nonzero(near & ~sure)
        row, column = rows[row], column + low
        found = metric_index.gaps_of(x, y, row, column) <= eps
        row, column = row[found], column[found]
        if listed:
            i, j = np.nonzero(sure)
            row, column = np.concatenate([row, rows[i]]), np.concatenate([column, j + low])
        yield rows, sure.sum(axis=1), row, column


def forest(edges: np.ndarray, n: int) -> np.ndarray:
    """Edges, fewer than `n`, that connect the same of the numbers below `n` as `edges` (two rows of ends) do."""
    label = np.arange(n)
    ends = edges
    while True:
        ends = label[ends]
        ends = ends[:, ends[0] != ends[1]]
        if not ends.shape[1]:
            break
        np.minimum.at(label, ends.max(axis=0), ends.min(axis=0))
        while (label[label] != label).any():
            label = label[label]
    joined = np.flatnonzero(label != np.arange(n))
    return np.stack([joined, label[joined]])


def single_linkage(df: DataFrame, key: str, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The merges of single linkage: `gap, a, b`, the edges of the least spanning tree, ties by the smaller keys.

    Boruvka's rounds: components find their nearest row outside, and those edges merge components. Each row has a list of its nearest rows,
    made once. The edge of a component is known from these lists if it is shorter than the lists of all its rows that have no row outside
    left. Only when no component knows its edge, such rows look further, of all components but the largest, which the others will reach.
    A row looks only into rings that reach nearer than what its component is sure to find: the best of its lists, or the nearest
    ring, as seen from any of its rows, that holds a row of another component. Equal rows hang on the one with the smallest key, which stands for
    them, so they do not fill the lists.
    """
    points = df.select(F.col(key).cast("long").alias("key"), as_array(df, "features").alias("features")).where("key IS NOT NULL")
    points, tree = _without_copies(points)
    index = metric_index.build(points, cell_rows, block_rows)
    rings = index.rings
    donors = points.withColumn("label", F.lit(0.0))
    near = cut_lineage(nearest(donors, donors, LISTED, skip_self=True, block_rows=block_rows, cell_rows=cell_rows).select("key", "donor", "gap"))
    labels = cut_lineage(index.rows.select("key", F.col("key").alias("comp")))

    def outside(a: pd.DataFrame, b: pd.DataFrame, masks) -> pd.DataFrame:
        columns = ["comp", "gap", "a", "b", "other"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in columns})
        b = b.iloc[np.argsort(b["ring"].to_numpy(), kind="stable")]
        x, y = stacked(a["features"]), stacked(b["features"])
        keys, comps, names, others = (v.to_numpy() for v in (a["key"], a["comp"], b["key"], b["comp"]))
        known, code = np.unique(comps, return_inverse=True)
        limit = np.full(len(known), np.inf)
        np.minimum.at(limit, code, np.square(a["reach"].to_numpy(dtype=float)) * (1 + 1e-12))
        kept, waiting = pd.DataFrame({c: [] for c in columns}), []
        first = lambda found: found.sort_values(["gap", "a", "b"], kind="stable").drop_duplicates("comp")
        for screen, rows, low, high in metric_index.screened(x, y, b["ring"].to_numpy(), masks(a)):
            parts = screen.parts(rows, low, high)
            parts[comps[rows, None] == others[None, low:high]] = np.inf
            # What the nearest of these rows surely is within, for the whole component.
            np.minimum.at(limit, code[rows], screen.squared(rows, parts.min(axis=1).astype(float)))
            row, column = np.nonzero((parts <= screen.above(rows, limit[code[rows]])) & np.isfinite(parts))
            row, column = rows[row], column + low
            pair = np.minimum(keys[row], names[column]), np.maximum(keys[row], names[column])
            waiting.append(pd.DataFrame(dict(zip(columns, (comps[row], metric_index.gaps_of(x, y, row, column), *pair, others[column])))))
            if sum(map(len, waiting)) > 500_000:
                kept, waiting = first(pd.concat([kept, *waiting] if len(kept) else waiting)), []
        return first(pd.concat([kept, *waiting] if len(kept) or not waiting else waiting))[columns]

    while True:
        comps = cut_lineage(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
        if comps.limit(2).count() < 2:
            break
        best, rows = _known_edges(near, labels, comps)
        if rows is None:
            tree, labels = _merged(tree, labels, comps, best)
            continue
        # Of these rows some component must look further; `best` is what the lists of their components have.
        known, rows = best, cut_lineage(index.rows.join(labels, "key").join(rows, "key", "left"))
        ends = rows.groupBy("ring").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).toPandas()
        # The component that a ring is wholly of, or none.
        pure = np.full(len(rings), np.iinfo(np.int64).min)
        pure[ends["ring"]] = np.where(ends["low"] == ends["high"], ends["low"], np.iinfo(np.int64).min)

        def sure(batches: Iterable[pd.DataFrame], pure=pure) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for piece in metric_index.pieces(batch, len(rings)):
                    comps = piece["comp"].to_numpy()
                    upper = np.where(pure[None, :] == comps[:, None], np.inf, rings.bounds(stacked(piece["features"]))[1])
                    yield pd.DataFrame({"comp": comps, "reach": upper.min(axis=1)}).groupby("comp", as_index=False).min()

        asking = rows.where("asks").drop("ring", "asks")
        reach = asking.select("comp", "features").mapInPandas(sure, "comp long, reach double").groupBy("comp").agg(F.min("reach").alias("reach"))
        reach = reach.join(known.select("comp", F.col("gap").alias("_gap")), "comp", "left").select("comp", F.least("reach", "_gap").alias("reach"))

        def wants(x: np.ndarray, batch: pd.DataFrame, pure=pure) -> np.ndarray:
            other = pure[None, :] != batch["comp"].to_numpy()[:, None]
            return other & (rings.bounds(x)[0] <= batch["reach"].to_numpy()[:, None])

        visitors = asking.join(reach, "comp")
        met = metric_index.tiles(visitors, index, wants, outside, "comp long, gap double, a long, b long, other long", block_rows, rows.drop("asks"))
        met = met.unionByName(known.join(visitors.select("comp").distinct(), "comp", "left_semi"))
        best = cut_lineage(met.groupBy("comp").agg(F.min(F.struct("gap", "a", "b", "other")).alias("e")).select("comp", "e.*"))
        tree, labels = _merged(tree, labels, comps, best)
    return tree if tree is not None else points.select(F.lit(0.0).alias("gap"), F.col("key").alias("a"), F.col("key").alias("b")).limit(0)


def _without_copies(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of equal rows the one with the smallest key, and the edges of the others to it; all rows if a key comes with different features."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    points = points.where(F.col("features").isNotNull() & F.forall("features", finite))
    first = points.groupBy("features").agg(F.min("key").alias("first"))
    named = cut_lineage(points.join(first, "features").select("key", "first").distinct())
    if named.where("key <> first").isEmpty() or named.count() > named.select("key").distinct().count():
        return points, None
    edges = named.where("key <> first").select(F.lit(0.0).alias("gap"), F.col("first").alias("a"), F.col("key").alias("b"))
    return cut_lineage(first.select(F.col("first").alias("key"), "features")), cut_lineage(edges)


def _known_edges(near: DataFrame, labels: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges (comp, gap, a, b, other) that lists are sure of, or, if there are none, the best of the lists and `key, asks` of rows that must look.

    A row whose list is all of its own component has nothing outside nearer than the end of the list.
    """
    own = near.join(labels, "key").join(labels.select(F.col("key").alias("donor"), F.col("comp").alias("other")), "donor")
    pair = F.struct("gap", F.least("key", "donor").alias("a"), F.greatest("key", "donor").alias("b"), "other")
    lists = own.groupBy("key").agg(F.min("comp").alias("comp"), F.min(F.when(F.col("comp") != F.col("other"), pair)).alias("e"))
    ends = near.groupBy("key").agg(F.max("gap").alias("end"))
    lists = cut_lineage(labels.distinct().join(ends, "key", "left").join(lists.drop("comp"), "key", "left"))
    found = lists.groupBy("comp").agg(F.min("e").alias("e"), F.min(F.when(F.col("e").isNull(), F.coalesce("end", F.lit(0.0)))).alias("end"))
    found = cut_lineage(found)
    best = found.where("e IS NOT NULL").select("comp", "e.*", "end")
    sure = best.where("end IS NULL OR gap < end").drop("end")
    if not sure.isEmpty():
        return sure, None
    largest = comps.orderBy(F.desc("n"), "comp").first()["comp"]
    waiting = lists.where("e IS NULL").select("key", "comp", "end").join(best.select("comp", "gap"), "comp", "left")
    asks = waiting.where((F.col("comp") != largest) & (F.col("gap").isNull() | (F.coalesce("end", F.lit(0.0)) <= F.col("gap"))))
    return best.drop("end"), asks.select("key", F.lit(True).alias("asks")).distinct()


def _merged(tree: DataFrame | None, labels: DataFrame, comps: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree with the edges `best`, and the components that they make."""
    edges = best.select("gap", "a", "b").distinct()
    tree = cut_lineage(edges if tree is None else tree.unionByName(edges))
    links = best.select(F.col("comp").alias("a"), F.col("other").alias("b"))
    if comps.count() <= DRIVER_LINKS:
        # At most one link per component.
        found = links.toPandas().to_numpy(dtype=np.int64).T
        names, code = np.unique(found, return_inverse=True)
        joined, to = forest(code.reshape(found.shape), len(names))
        made = pd.DataFrame({"comp": names[joined], "cluster": names[to]})
        merged = F.broadcast(labels.sparkSession.createDataFrame(made, "comp long, cluster long"))
    else:
        merged = connected_components(comps.select(F.col("comp").alias("key")), links).withColumnRenamed("key", "comp")
    return tree, cut_lineage(labels.join(merged, "comp", "left").select("key", F.coalesce("cluster", "comp").alias("comp")))


def agglomerative(df: DataFrame, key: str, n_clusters: int = 2, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, cluster): single linkage cut to `n_clusters`; a cluster is named by its smallest key.

    The last merges are undone: the largest edges of the tree go, of equal ones those with the larger keys.
    """
    tree = single_linkage(df, key, block_rows, cell_rows)
    last = tree.orderBy(F.desc("gap"), F.desc("a"), F.desc("b")).limit(n_clusters - 1)
    kept = tree.join(F.broadcast(last.select("a", "b")), ["a", "b"], "left_anti") if n_clusters > 1 else tree
    found = connected_components(df.select(F.col(key).cast("long").alias("key")), kept.select("a", "b"))
    return found.withColumnRenamed("key", key)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(key, cluster) with the smallest key of every component.

    Alternating star rounds: every node links its larger, then its smaller neighbours to the smallest one around. The
    number of edges does not grow and the rounds are logarithmic. Each round is written to the checkpoint folder.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionByName(
            links.select(F.col("lo").alias("v"), F.col("hi").alias("w"))
        )
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("w > v").join(least, "v").select(F.col("w").alias("hi"), F.col("m").alias("lo")).distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(small_least, "hi")
            .select(F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))))
            .where("hi <> lo")
            .distinct()
        )
        links = cut_lineage(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ArithmeticError("the components did not settle")
    found = links.groupBy("hi").agg(F.min("lo").alias("cluster"))
    return nodes.join(found.withColumnRenamed("hi", "key"), "key", "left").select(
        "key", F.coalesce("cluster", "key").alias("cluster")
    )


class TableClusters(NearestNeighbours):
    """Clusters that a method finds on the table it is given; any row then takes the cluster of its nearest row of that table.

    A row of the table is its own nearest row, so it keeps its cluster (equal rows are always in one). Density clusters have
    a reach: a row farther than `eps` from every row of the table is noise, -1. `prediction` is a number from 0 on, by the smallest key.
    """

    def __init__(self, method: str, **options):
        super().__init__("clustering", 1)
        self.method, self.options = method, options

    def fit(self, df: DataFrame) -> "TableClusters":
        rows = df.select(F.monotonically_increasing_id().alias("key"), as_array(df, "features").alias("features")).where("features IS NOT NULL")
        rows = cut_lineage(rows)
        found = METHODS[self.method](rows, "key", **self.options)
        names = row_rank(found.where("cluster <> -1").groupBy("cluster").agg(F.min("key").alias("least")), "least")
        found = found.join(names.select("cluster", (F.col("row_rank") - F.lit(1)).cast("double").alias("label")), "cluster", "left")
        labelled = rows.join(found, "key").select("key", "features", F.coalesce("label", F.lit(-1.0)).alias("label"))
        self.rows = cut_lineage(labelled.dropDuplicates(["features"]))
        self.classes = 0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        named = df.withColumn("_x", F.xxhash64(as_array(df, "features")))
        wanted = named.select(F.col("_x").alias("key"), "features").dropDuplicates(["key"])
        near = nearest(wanted, self.rows, 1, block_rows=self.block_rows)
        reach = self.options.get("eps")
        label = F.when(F.col("gap") <= reach, F.col("label")).otherwise(-1.0) if reach is not None else F.col("label")
        return named.join(near.select(F.col("key").alias("_x"), label.cast("int").alias("prediction")), "_x").drop("_x")


METHODS = {"dbscan": dbscan, "agglomerative": agglomerative, "spectral": spectral}
