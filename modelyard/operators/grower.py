"""Trees grown level by level in Spark: extremely randomised trees, and second-order boosting in three ways of growing.

A tree is a few arrays on the driver. Rows carry no state: a task walks each row down the trees so far. They are packed first, one
row per batch with its numbers as bytes, as the passes are many and converting single rows would be most of their time. One pass over the rows
serves all open nodes, of all trees of a forest or of all class trees of a boosting round, and sends (node, feature, ...) sums that
Spark adds up before the shuffle; of a node only its best split, or its sums, reach the driver. Nodes are taken in groups when
they are many, so that driver and task hold a bounded table. Boosting walks and sums the bins alone, and rows of a chunk that share all of
them are one with a weight: the trees cannot tell them apart.
"""

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from modelyard import settings
from modelyard.functions.vectors import as_array
from modelyard.operators.metric_index import stacked
from modelyard.operators.plain import PlainModel
from modelyard.session import balanced, cut_lineage

# Numbers (nodes x features) of one pass.
TABLE_SIZE = 400_000
ROUNDS_PER_CHECKPOINT = 8
# Most rows and most numbers of a chunk whose equal bins become one row, and most rows of a packed row of it.
CHUNK_ROWS, CHUNK_NUMBERS, PIECE_ROWS = 1 << 19, 1 << 23, 1 << 16


@dataclass
class Tree:
    """Nodes by number: a feature (-1 at a leaf), a threshold (rows at or below it go left), the left child (the right one follows), values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])
    # Where a node is, whatever the order of growing: the children of 1 are 2 and 3, and so on.
    path: list[int] = field(default_factory=lambda: [1])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.gain[node] = float(gain)
        self.feature[node], self.threshold[node], self.left[node] = int(feature), float(threshold), at
        for side in range(2):
            self.path.append(2 * self.path[node] + side)
            self.gain.append(0.0)
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.value.append([0.0])
        return at, at + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, threshold, left = (np.array(v) for v in (self.feature, self.threshold, self.left))
        node = np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            at = node[inner]
            node[inner] = left[at] + (x[np.flatnonzero(inner), feature[at]] > threshold[at])
        return node

    def to_list(self) -> list:
        return [self.feature, self.threshold, self.left, self.value, self.path, self.gain]


def hash_share(*parts) -> float:
    """A number from 0 to 1 that any engine with md5 can draw again: 52 bits of the parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def values_of(trees: list[list[Tree]], x: np.ndarray) -> np.ndarray:
    """The summed leaf values of each column of trees: `trees[round][column]`."""
    total = np.zeros((len(x), len(trees[0]) if trees else 1))
    for column in trees:
        for k, tree in enumerate(column):
            total[:, k] += np.array([v[0] for v in tree.value])[tree.leaves(x)]
    return total


PACKED = "n int, x binary, label binary"


def packed(rows: DataFrame, edges: list[np.ndarray] | None = None, width: int = 1) -> DataFrame:
    """`rows` (features, label, and margin with `edges`) a batch a row: features, labels, margins and the bins of the features as bytes."""

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = stacked(batch["features"])
                row = {"n": len(x), "x": x.tobytes(), "label": batch["label"].to_numpy(dtype=float).tobytes()}
                if edges is not None:
                    bins = [np.searchsorted(e, x[:, f]).astype(np.int32) for f, e in enumerate(edges)]
                    row |= {"bins": np.stack(bins).tobytes(), "margin": stacked(batch["margin"]).tobytes()}
                yield pd.DataFrame([row])

    return rows.mapInPandas(pack, PACKED + (", bins binary, margin binary" if edges is not None else ""))


def unpacked(batches: Iterable[pd.DataFrame], kind: type = np.int32) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each packed batch: bins by feature, label and weight flat, the others by row."""
    for batch in batches:
        for row in batch.to_dict("records"):
            n = int(row.pop("n"))
            out = {c: np.frombuffer(v, kind if c == "bins" else float) for c, v in row.items()}
            yield {c: v if c in ("label", "weight") else v.reshape(-1, n) if c == "bins" else v.reshape(n, -1) for c, v in out.items()}


def bin_kind(edges: list[np.ndarray]) -> type:
    """The least whole number that holds every bin and the mark of NaN."""
    return np.min_scalar_type(max((len(e) for e in edges), default=0) + 1).type


def binned(rows: DataFrame, edges: list[np.ndarray], start: list[float], subsample: bool, by_label: bool) -> DataFrame:
    """`rows` (features, label) as bins, a piece of a chunk a row: bins of the features, labels, margins, weights, and the features if rows are drawn.

    Rows of a chunk with the same bins, and label if `by_label`, become one with their number as weight and their mean label, unless rows
    are drawn or the features are too many for a 63-bit code. A NaN has the mark after the last bin.
    """
    kind = bin_kind(edges)
    sizes = [len(e) + 2 for e in edges]
    most = max(1, min(CHUNK_ROWS, CHUNK_NUMBERS // max(1, len(edges))))

    def merged(bins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels, place = np.unique(label, return_inverse=True) if by_label else (np.zeros(1), 0)
        if subsample or math.prod([*sizes, len(labels)]) >= 1 << 63:
            return bins, label, np.ones(len(label))
        code = np.zeros(len(label), np.int64) + place
        for own, size in zip(bins, sizes):
            code = code * size + own
        _, first, group, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        return bins[:, first], label[first] if by_label else np.bincount(group, label) / n, n.astype(float)

    def pieces(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        x, label = (np.concatenate(v) for v in zip(*waiting))
        bins = [np.where(np.isnan(x[:, f]), len(e) + 1, np.searchsorted(e, x[:, f])).astype(kind) for f, e in enumerate(edges)]
        bins, label, weight = merged(np.stack(bins), label)
        for i in range(0, len(label), PIECE_ROWS):
            at = slice(i, i + PIECE_ROWS)
            row = {"n": len(label[at]), "bins": bins[:, at].tobytes(), "label": label[at].tobytes(), "weight": weight[at].tobytes()}
            row["margin"] = np.tile(np.array(start, float), (row["n"], 1)).tobytes()
            yield pd.DataFrame([row | ({"x": x[at].tobytes()} if subsample else {})])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if len(batch):
                waiting.append((stacked(batch["features"]), batch["label"].to_numpy(dtype=float)))
            if sum(len(y) for _, y in waiting) >= most:
                yield from pieces(waiting)
                waiting = []
        if waiting:
            yield from pieces(waiting)

    return rows.mapInPandas(run, BINNED + (", x binary" if subsample else ""))


BINNED = "n int, bins binary, label binary, weight binary, margin binary"


def walk(tree: Tree, edges: list[np.ndarray], bins: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows in each of the leaves `wanted`, found by bins; NaN goes left."""
    wanted = set(wanted)
    needed = [node in wanted for node in range(len(tree.feature))]
    for node in reversed(range(len(needed))):
        if tree.feature[node] >= 0:
            needed[node] = needed[tree.left[node]] or needed[tree.left[node] + 1]
    rows = {0: np.arange(bins.shape[1])}
    for node, f in enumerate(tree.feature):
        if needed[node]:
            own = rows.pop(node)
            if f < 0:
                yield node, own
            else:
                at = bins[f][own]
                right = (at > np.searchsorted(edges[f], tree.threshold[node])) & (at <= len(edges[f]))
                rows[tree.left[node]], rows[tree.left[node] + 1] = own[~right], own[right]


def _channels(task: str, label: np.ndarray, classes: int) -> np.ndarray:
    """What is summed in a node: rows per class, or rows, labels and their squares."""
    if task == "classification":
        return (label[:, None] == np.arange(classes)[None, :]).astype(float)
    return np.stack([np.ones(len(label)), label, label * label], axis=1)


def _impurity(task: str, sums: np.ndarray) -> np.ndarray:
    """Rows times the Gini impurity, or the sum of squared gaps to the mean; `sums` has the channels in its last axis."""
    if task == "classification":
        n = sums.sum(axis=-1)
        return n - np.divide((sums**2).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)
    n = sums[..., 0]
    return sums[..., 2] - np.divide(sums[..., 1] ** 2, n, out=np.zeros_like(n), where=n > 0)


class ExtraTrees:
    """A forest of extremely randomised trees: of each drawn feature of a node one threshold is drawn, even between the node's least and
    largest value, and the best of those splits is taken. All rows grow every tree.

    A node is split while it has `min_samples_split` rows, differing labels, and depth; both sides keep `min_samples_leaf`.
    """

    def __init__(
        self, task: str, n_estimators: int = 100, max_depth: int = 10, min_samples_split: int = 2, min_samples_leaf: int = 1,
        max_features: float | str | None = None, seed: int = settings.RANDOM_STATE,
    ):
        self.task, self.n_estimators, self.max_depth, self.seed = task, n_estimators, max_depth, seed
        self.least_split, self.least_leaf = max(2, min_samples_split), min_samples_leaf
        self.max_features = max_features or ("sqrt" if task == "classification" else 1.0)

    def fit(self, df: DataFrame) -> "Forest":
        rows = balanced(df.select(as_array(df, "features").alias("features"), F.col("label").cast("double").alias("label"))).persist()
        try:
            head = rows.agg(F.max(F.size("features")).alias("p"), F.max("label").alias("top"), F.count(F.lit(1)).alias("n")).first()
            if not head["n"]:
                raise ValueError("the table is empty")
            self.p = head["p"]
            self.classes = int(head["top"]) + 1 if self.task == "classification" else 0
            return Forest(self.task, self.classes, self.p, self._grow(rows))
        finally:
            rows.unpersist()

    def drawn_features(self, tree: int, path: int) -> np.ndarray:
        """The features of a node that hash lowest."""
        wanted = math.isqrt(self.p) if self.max_features == "sqrt" else round(float(self.max_features) * self.p)
        order = sorted(range(self.p), key=lambda f: (hash_share(self.seed, "feature", tree, path, f), f))
        return np.sort(np.array(order[: max(1, min(self.p, wanted))]))

    def threshold(self, tree: int, path: int, feature: int, low: float, high: float) -> float:
        """Even between the least and the largest value; never the largest, which would leave the right side empty."""
        share = hash_share(self.seed, "cut", tree, path, feature)
        return min(low + share * (high - low), float(np.nextafter(high, -np.inf)))

    def _grow(self, rows: DataFrame) -> list[Tree]:
        trees = [Tree() for _ in range(self.n_estimators)]
        root = self._root(rows)
        rows = packed(rows).persist()
        try:
            return self._levels(rows, trees, root)
        finally:
            rows.unpersist()

    def _levels(self, rows: DataFrame, trees: list[Tree], root: np.ndarray) -> list[Tree]:
        known = {(t, 0): root for t in range(len(trees))}
        for tree in trees:
            tree.value[0] = root.tolist()
        for depth in range(self.max_depth):
            open_nodes = [key for key, sums in known.items() if self._splits(sums)]
            known = {}
            width = max(1, len(self.drawn_features(0, 1)))
            step = max(1, TABLE_SIZE // (width * len(root)))
            for i in range(0, len(open_nodes), step):
                known |= self._level(rows, trees, open_nodes[i : i + step])
            if not known:
                break
        return trees

    def _splits(self, sums: np.ndarray) -> bool:
        n = sums.sum() if self.task == "classification" else sums[0]
        return n >= max(self.least_split, 2 * self.least_leaf) and _impurity(self.task, sums) > 1e-12 * max(1.0, abs(sums).max())

    def _root(self, rows: DataFrame) -> np.ndarray:
        if self.task == "classification":
            counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            return np.array([counts.get(c, 0) for c in range(self.classes)], float)
        return np.array(rows.agg(F.count("label"), F.sum("label"), F.sum(F.col("label") * F.col("label"))).first(), float)

    def _level(self, rows: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Split what can be split of `nodes` (tree, node); gives the new nodes with their sums."""
        drawn = {key: self.drawn_features(key[0], trees[key[0]].path[key[1]]) for key in nodes}
        pairs = [(key, f) for key in nodes for f in drawn[key].tolist()]
        place = {pair: i for i, pair in enumerate(pairs)}
        by_tree: dict[int, list[int]] = {}
        for t, node in nodes:
            by_tree.setdefault(t, []).append(node)
        task, classes = self.task, self.classes

        def members(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
            """Rows of each of the nodes that are open."""
            for t, wanted in by_tree.items():
                leaf = trees[t].leaves(x)
                order = np.argsort(leaf, kind="stable")
                edges = np.searchsorted(leaf[order], wanted), np.searchsorted(leaf[order], wanted, side="right")
                for node, a, b in zip(wanted, *edges):
                    if b > a:
                        yield t, node, order[a:b]

        def ranges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high = np.full(len(pairs), np.inf), np.full(len(pairs), -np.inf)
            for batch in unpacked(batches):
                x = batch["x"]
                for t, node, own in members(x):
                    for f in drawn[t, node].tolist():
                        at, values = place[(t, node), f], x[own, f]
                        low[at], high[at] = min(low[at], values.min()), max(high[at], values.max())
            some = np.flatnonzero(np.isfinite(low))
            yield pd.DataFrame({"i": some, "low": low[some], "high": high[some]})

        found = rows.select("n", "x").mapInPandas(ranges, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        cuts = np.full(len(pairs), np.nan)
        for r in found.collect():
            if r["low"] < r["high"]:
                (t, node), f = pairs[r["i"]]
                cuts[r["i"]] = self.threshold(t, trees[t].path[node], f, r["low"], r["high"])

        def left_sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: np.ndarray | None = None
            for batch in unpacked(batches):
                x, channels = batch["x"], _channels(task, batch["label"], classes)
                total = np.zeros((len(pairs), channels.shape[1] * 2)) if total is None else total
                for t, node, own in members(x):
                    whole = channels[own].sum(axis=0)
                    for f in drawn[t, node].tolist():
                        at = place[(t, node), f]
                        if not np.isnan(cuts[at]):
                            total[at] += np.concatenate([channels[own[x[own, f] <= cuts[at]]].sum(axis=0), whole])
            if total is not None:
                row, channel = np.nonzero(total)
                yield pd.DataFrame({"i": row, "c": channel, "v": total[row, channel]})

        sums = rows.mapInPandas(left_sums, "i long, c int, v double").groupBy("i", "c").agg(F.sum("v").alias("v")).toPandas()
        width = len(_channels(task, np.zeros(1), classes)[0])
        both = np.zeros((len(pairs), 2 * width))
        both[sums["i"], sums["c"]] = sums["v"]
        left, right = both[:, :width], both[:, width:] - both[:, :width]
        n_left, n_right = (s.sum(axis=1) if task == "classification" else s[:, 0] for s in (left, right))
        gain = _impurity(task, left + right) - _impurity(task, left) - _impurity(task, right)
        gain[np.isnan(cuts) | (n_left < self.least_leaf) | (n_right < self.least_leaf)] = -np.inf
        out: dict[tuple[int, int], np.ndarray] = {}
        for key in nodes:
            at = [place[key, f] for f in drawn[key].tolist()]
            best = at[int(np.argmax(gain[at]))]
            if np.isfinite(gain[best]):
                ends = trees[key[0]].split(key[1], pairs[best][1], cuts[best], gain[best])
                for end, own in zip(ends, (left[best], right[best])):
                    trees[key[0]].value[end] = own.tolist()
                    out[key[0], end] = own
        return out


class Forest(PlainModel):
    """A fitted forest; leaves hold the sums of their rows."""

    state_names = ("task", "classes", "width", "state")

    def __init__(self, task: str, classes: int, width: int, trees: list[Tree]):
        # Trees of all sizes are no table; a stored model keeps what is in a dictionary as it is.
        self.task, self.classes, self.width, self.state = task, classes, width, {"trees": [t.to_list() for t in trees]}

    @property
    def grown(self) -> list[Tree]:
        return [Tree(*t) for t in self.state["trees"]]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return _importances(self.grown, self.width)

    def transform(self, df: DataFrame) -> DataFrame:
        trees, task, width = self.grown, self.task, self.classes or 1

        @pandas_udf("array<double>")
        def vote(features: pd.Series) -> pd.Series:
            x = stacked(features)
            total = np.zeros((len(x), width))
            for tree in trees:
                sums = np.array(tree.value)
                share = sums / sums.sum(axis=1, keepdims=True) if task == "classification" else (sums[:, 1] / sums[:, 0])[:, None]
                total += share[tree.leaves(x)]
            return pd.Series(list(total / len(trees)))

        out = df.withColumn("_votes", vote(as_array(df, "features")))
        if task == "regression":
            return out.withColumn("prediction", F.get("_votes", 0)).drop("_votes")
        best = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_votes")).drop("_votes")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """`tree, path, feature, threshold, sums` of every node: the root's path is 1, its children's 2 and 3; a leaf has the feature -1."""
        rows = []
        for t, tree in enumerate(self.grown):
            rows += [(t, *node) for node in zip(tree.path, tree.feature, tree.threshold, tree.value)]
        return spark.createDataFrame(rows, "tree int, path long, feature int, threshold double, sums array<double>")


def _importances(trees: list[Tree], p: int) -> DenseVector:
    """Per feature the summed gains of its splits, as a share of all."""
    total = np.zeros(p)
    for tree in trees:
        for feature, gain in zip(tree.feature, tree.gain):
            if feature >= 0:
                total[feature] += gain
    return DenseVector(total / total.sum() if total.sum() > 0 else total)


# How a boosting round grows its trees: fixed values of the three designs.
STYLES = {
    "depth": {"max_depth": 6, "l2": 1.0, "learning_rate": 0.3, "bins": 256, "least_rows": 1, "least_weight": 1.0},
    "leaf": {"max_leaves": 31, "l2": 0.0, "learning_rate": 0.1, "bins": 255, "least_rows": 20, "least_weight": 1e-3},
    "level": {"max_depth": 6, "l2": 3.0, "learning_rate": 0.03, "bins": 254, "least_rows": 1, "least_weight": 0.0},
}


class SecondOrderBoosting:
    """Boosting on the gradient G and the hessian H of the loss: a leaf is -G / (H + l2), a split gains the sum of G^2 / (H + l2) of its sides
    minus that of the node. Candidates are the edges of quantile bins.

    `depth` splits every node of a level that gains; `leaf` always splits the leaf that gains most, up to `max_leaves`; `level`
    gives all nodes of a level the one split that gains most in sum. Losses: squares, or log loss with a tree per class (one for two classes).
    """

    def __init__(self, task: str, style: str, n_estimators: int = 100, seed: int = settings.RANDOM_STATE, **options):
        self.task, self.style, self.rounds, self.seed = task, style, n_estimators, seed
        self.options = {"subsample": 1.0, "columns": 1.0, "min_gain": 0.0, "max_leaves": 1 << 30, "max_depth": 1 << 30, **STYLES[style], **options}

    def fit(self, df: DataFrame) -> "Boosted":
        o = self.options
        source = df.select(as_array(df, "features").alias("features"), F.col("label").cast("double").alias("label"))
        head = source.agg(F.max(F.size("features")).alias("p"), F.max("label").alias("top"), F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n")).first()
        if not head["n"]:
            raise ValueError("the table is empty")
        self.p = head["p"]
        classes = int(head["top"]) + 1 if self.task == "classification" else 0
        self.columns = 1 if classes <= 2 else classes
        if self.task == "regression":
            start = [head["mean"]]
        elif self.columns == 1:
            share = min(max(head["mean"], 1e-6), 1 - 1e-6)
            start = [math.log(share / (1 - share))]
        else:
            start = [0.0] * classes
        edges = self._edges(source)
        rows = binned(source, edges, start, o["subsample"] < 1, self.columns > 1)
        # The pieces are spread, and not the rows.
        rows = cut_lineage(balanced(rows))
        done: list[list[Tree]] = []
        fresh: list[list[Tree]] = []
        for number in range(self.rounds):
            now = self._advanced(rows, fresh, edges).persist() if fresh else rows
            try:
                trees = self._round(now, edges, number)
            finally:
                if fresh:
                    now.unpersist()
            if all(len(t.feature) == 1 and abs(t.value[0][0]) < 1e-15 for t in trees):
                break
            done.append(trees)
            fresh.append(trees)
            if len(fresh) == ROUNDS_PER_CHECKPOINT:
                rows, fresh = cut_lineage(self._advanced(rows, fresh, edges)), []
        return Boosted(self.task, classes, self.p, start, done)

    def _edges(self, rows: DataFrame) -> list[np.ndarray]:
        """Up to bins - 1 cut points of every feature."""
        shares = [i / self.options["bins"] for i in range(1, self.options["bins"])]
        found: list[np.ndarray] = []
        for i in range(0, self.p, 50):
            some = range(i, min(self.p, i + 50))
            row = rows.agg(*[F.percentile_approx(F.get("features", j), shares, 100_000).alias(f"q{j}") for j in some]).first()
            found += [np.unique(np.array(row[f"q{j}"] if row[f"q{j}"] is not None else [], float)) for j in some]
        return found

    def _advanced(self, rows: DataFrame, trees: list[list[Tree]], edges: list[np.ndarray]) -> DataFrame:
        kind = bin_kind(edges)

        def moved(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                margins = []
                for part in unpacked([batch[["n", "bins", "margin"]]], kind):
                    margin = part["margin"].copy()
                    for column in trees:
                        for k, tree in enumerate(column):
                            for leaf, own in walk(tree, edges, part["bins"], [node for node, f in enumerate(tree.feature) if f < 0]):
                                margin[own, k] += tree.value[leaf][0]
                    margins.append(margin.tobytes())
                yield batch.assign(margin=margins)

        return rows.mapInPandas(moved, rows.schema)

    def _round(self, rows: DataFrame, edges: list[np.ndarray], number: int) -> list[Tree]:
        """One tree per column, grown on the gradients after the trees so far."""
        o = self.options
        trees = [Tree() for _ in range(self.columns)]
        rng = np.random.default_rng([self.seed, number])
        chosen = np.sort(rng.permutation(self.p)[: max(1, round(o["columns"] * self.p))])
        # What is known of a node: its sums, and its best split (gain, feature, cut, sums of the left side).
        known: dict[tuple[int, int], dict] = {}
        pending = [(k, 0) for k in range(self.columns)]
        depth = {key: 0 for key in pending}
        while pending:
            step = max(1, TABLE_SIZE // (len(chosen) * 64))
            for i in range(0, len(pending), step):
                known |= self._best_splits(rows, trees, pending[i : i + step], edges, chosen, number)
            if self.style == "level":
                pending = self._split_level(trees, known, pending, depth)
            elif self.style == "depth":
                pending = [end for key in pending if depth[key] < o["max_depth"] for end in self._split(trees, known, key, depth)]
            else:
                pending = self._split_leaves(trees, known)
        if self.style == "leaf":
            return [self._best_first(k, trees[k], known)[0] for k in range(self.columns)]
        for (k, node), what in known.items():
            trees[k].value[node] = self._value(what["sums"])
        return trees

    def _value(self, sums: tuple[float, float, float]) -> list[float]:
        o, (_, g, h) = self.options, sums
        return [-o["learning_rate"] * g / (h + o["l2"]) if h + o["l2"] > 0 else 0.0]

    def _split(self, trees: list[Tree], known: dict, key: tuple[int, int], depth: dict) -> list[tuple[int, int]]:
        what = known[key]
        if what["gain"] is None or what["gain"] <= self.options["min_gain"]:
            return []
        ends = [(key[0], node) for node in trees[key[0]].split(key[1], what["feature"], what["cut"], what["gain"])]
        for end in ends:
            depth[end] = depth[key] + 1
        return ends

    def _split_leaves(self, trees: list[Tree], known: dict) -> list[tuple[int, int]]:
        """The nodes that must still be looked at; `trees` grow by every split that is, or may turn out to be, one of the best."""
        return [(k, node) for k, tree in enumerate(trees) for node in self._best_first(k, tree, known)[1]]

    def _best_first(self, k: int, tree: Tree, known: dict) -> tuple[Tree, list[int]]:
        """The tree that always splits the leaf that gains most, and what nodes of `tree` it still depends on.

        While some nodes are unknown it is grown as if they gained nothing. They could only take the place of splits, so every known node that
        can be split at all is split here, and the children of all these are looked at together, a pass a level. `tree` has all splits
        met so far; the nodes of the result are numbered in the order of its own. The last children need no pass: the split has their sums.
        """
        o, out, at, sums, surely = self.options, Tree(), [0], [known[k, 0]["sums"]], True
        out.value[0] = self._value(sums[0])
        leaves = [0]
        while len(leaves) < o["max_leaves"]:
            gains = {leaf: known[k, at[leaf]]["gain"] for leaf in leaves if (k, at[leaf]) in known and out.path[leaf].bit_length() <= o["max_depth"]}
            able = [leaf for leaf, gain in gains.items() if gain is not None and gain > o["min_gain"]]
            surely &= all((k, at[leaf]) in known for leaf in leaves)
            if not able:
                break
            best = max(able, key=lambda leaf: (gains[leaf], -leaf))
            what = known[k, at[best]]
            if tree.left[at[best]] < 0:
                tree.split(at[best], what["feature"], what["cut"], what["gain"])
            ends = out.split(best, what["feature"], what["cut"], what["gain"])
            at += [tree.left[at[best]], tree.left[at[best]] + 1]
            sums += [what["left"], tuple(a - b for a, b in zip(what["sums"], what["left"]))]
            for end in ends:
                out.value[end] = self._value(known[k, at[end]]["sums"] if (k, at[end]) in known else sums[end])
            leaves = [leaf for leaf in leaves if leaf != best] + [*ends]
        return out, [] if surely else [at[leaf] for leaf in leaves if (k, at[leaf]) not in known]

    def _split_level(self, trees: list[Tree], known: dict, pending: list, depth: dict) -> list[tuple[int, int]]:
        """All open nodes of a tree get the split whose gains add up to most."""
        out = []
        for k in range(len(trees)):
            own = [key for key in pending if key[0] == k]
            if not own or depth[own[0]] >= self.options["max_depth"]:
                continue
            gains: dict[tuple[int, float], float] = {}
            for key in own:
                for split, gain in known[key]["gains"].items():
                    gains[split] = gains.get(split, 0.0) + gain
            best = max(gains, key=lambda split: (gains[split], -split[0], -split[1]), default=None)
            if best is None or gains[best] <= self.options["min_gain"]:
                continue
            for key in own:
                ends = [(k, node) for node in trees[k].split(key[1], *best, known[key]["gains"].get(best, 0.0))]
                for end in ends:
                    depth[end] = depth[key] + 1
                out += ends
        return out

    def _best_splits(self, rows, trees, nodes, edges, chosen, number) -> dict[tuple[int, int], dict]:
        """Sums (rows, gradients, hessians) and splits of `nodes` (tree, node), from one pass over the rows."""
        o, task, columns = self.options, self.task, self.columns
        place = {key: i for i, key in enumerate(nodes)}
        seed, kind = self.seed, bin_kind(edges)

        def histogram(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            widest = max((len(edges[f]) for f in chosen.tolist()), default=0) + 1
            total: np.ndarray | None = None
            # The bin that a NaN counts in.
            holes = {f: np.searchsorted(edges[f], np.nan) for f in chosen.tolist()}
            for batch in unpacked(batches, kind):
                total = np.zeros((3, len(nodes), len(chosen), widest)) if total is None else total
                bins, label, weight = batch["bins"], batch["label"], batch["weight"]
                gradient, hessian = _derivatives(task, columns, batch["margin"], label)
                taken = _drawn(batch["x"], label, seed, number) < o["subsample"] if o["subsample"] < 1 else None
                for k in {k for k, _ in nodes}:
                    for node, own in walk(trees[k], edges, bins, [node for j, node in nodes if j == k]):
                        own = own if taken is None else own[taken[own]]
                        n = weight[own]
                        parts = n, n * gradient[own, k], n * hessian[own, k]
                        for j, f in enumerate(chosen.tolist()):
                            cells = bins[f][own].astype(np.int64)
                            cells[cells > len(edges[f])] = holes[f]
                            for c, weights in enumerate(parts):
                                total[c, place[k, node], j] += np.bincount(cells, weights, widest)
            if total is not None:
                place_of, j, cell = np.nonzero(total[0])
                n, g, h = total[:, place_of, j, cell]
                yield pd.DataFrame({"node": place_of, "f": chosen[j], "bin": cell, "n": n, "g": g, "h": h})

        # A task has summed its rows; one shuffle then serves the sums and both windows.
        cells = rows.mapInPandas(histogram, "node int, f int, bin int, n double, g double, h double").repartition("node", "f").groupBy("node", "f", "bin")
        cells = cells.agg(*[F.sum(c).alias(c) for c in "ngh"])
        # A window is one node and feature: as many rows as bins.
        whole = Window.partitionBy("node", "f")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sides = cells.select("node", "f", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ngh"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "ngh"])
        l2 = F.lit(float(o["l2"]))
        part = lambda g, h: F.when(h + l2 > 0, g * g / (h + l2)).otherwise(0.0)
        right = {c: F.col(f"t{c}") - F.col(f"l{c}") for c in "ngh"}
        gain: Column = part(F.col("lg"), F.col("lh")) + part(right["g"], right["h"]) - part(F.col("tg"), F.col("th"))
        able = (F.least("ln", right["n"]) >= max(1, o["least_rows"])) & (F.least("lh", right["h"]) >= o["least_weight"])
        judged = sides.withColumn("gain", F.when(able, gain / 2))
        if self.style == "level":
            # Every split of every node: nodes x features x bins rows at most, which one pass bounds.
            found = judged.where("gain IS NOT NULL").select("node", "f", "bin", "gain").toPandas()
        first = judged.groupBy("node").agg(
            *[F.min_by(f"t{c}", "f").alias(f"t{c}") for c in "ngh"], F.max(F.struct("gain", -F.col("f"), -F.col("bin"), "ln", "lg", "lh")).alias("best")
        )
        out: dict[tuple[int, int], dict] = {key: {"sums": (0.0, 0.0, 0.0), "gain": None, "gains": {}} for key in nodes}
        for r in first.collect():
            what = out[nodes[r["node"]]]
            what["sums"] = (r["tn"], r["tg"], r["th"])
            if r["best"]["gain"] is not None:
                f, b = -r["best"][1], -r["best"][2]
                what |= {"gain": r["best"]["gain"], "feature": f, "cut": float(edges[f][b]) if b < len(edges[f]) else None, "left": tuple(r["best"])[3:]}
                if what["cut"] is None:
                    what["gain"] = None
        if self.style == "level":
            for node, f, b, g in found.itertuples(index=False):
                if b < len(edges[f]):
                    out[nodes[node]]["gains"][int(f), float(edges[f][b])] = g
        return out


def _drawn(x: np.ndarray, label: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number from 0 to 1 per row and round that a re-run task draws again."""
    bits = np.hstack([x, label[:, None]]).view(np.uint64).copy()
    state = np.full(len(x), np.uint64(seed * 1_000_003 + number))
    for j in range(bits.shape[1]):
        state = (state ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
    return (state >> np.uint64(11)).astype(float) / float(1 << 53)


def _derivatives(task: str, columns: int, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if task == "regression":
        return margin - label[:, None], np.ones_like(margin)
    if columns == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(columns)), np.maximum(2 * p * (1 - p), 1e-16)


class Boosted(PlainModel):
    """A fitted sum of trees: `trees[round][column]`, on top of `start`."""

    state_names = ("task", "classes", "width", "start", "state")

    def __init__(self, task: str, classes: int, width: int, start: list[float], trees: list[list[Tree]]):
        self.task, self.classes, self.width, self.start = task, classes, width, list(start)
        self.state = {"trees": [[t.to_list() for t in column] for column in trees]}

    def rounds(self) -> list[list[Tree]]:
        return [[Tree(*t) for t in column] for column in self.state["trees"]]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return _importances([t for column in self.rounds() for t in column], self.width)

    def transform(self, df: DataFrame) -> DataFrame:
        trees, start = self.rounds(), np.array(self.start, float)

        @pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            x = stacked(features)
            return pd.Series(list(start + (values_of(trees, x) if trees else 0.0) + np.zeros((len(x), 1))))

        out = df.withColumn("_margin", margins(as_array(df, "features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.get("_margin", 0)).drop("_margin")
        if len(start) == 1:
            p = 1 / (1 + F.exp(-F.get("_margin", 0)))
            shares = F.array(1 - p, p)
        else:
            top = F.array_max("_margin")
            powers = F.transform("_margin", lambda m: F.exp(m - top))
            shares = F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v))
        out = out.withColumn("_shares", shares)
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_shares")).drop("_shares", "_margin")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """`round, column, path, feature, threshold, value` of every node; a leaf has the feature -1."""
        rows = []
        for r, trees in enumerate(self.rounds()):
            for k, tree in enumerate(trees):
                rows += [(r, k, p, f, c, v[0]) for p, f, c, v in zip(tree.path, tree.feature, tree.threshold, tree.value)]
        return spark.createDataFrame(rows, "round int, column int, path long, feature int, threshold double, value double")

    def leaf_rows(self, df: DataFrame, number: int, column: int = 0) -> DataFrame:
        """`df` with the leaf of each row in tree (`number`, `column`) and the `margin` before that round."""
        trees, start = self.rounds(), np.array(self.start, float)

        @pandas_udf("leaf int, margin double")
        def place(features: pd.Series) -> pd.DataFrame:
            x = stacked(features)
            before = start + (values_of(trees[:number], x) if number else np.zeros((len(x), len(start))))
            return pd.DataFrame({"leaf": trees[number][column].leaves(x).astype(np.int32), "margin": before[:, column]})

        return df.withColumn("_place", place(as_array(df, "features"))).select("*", "_place.leaf", "_place.margin").drop("_place")


def ordered_target_statistics(df: DataFrame, column: str, label: str, key: list[str], prior_weight: float = 1.0, seed: int = 0) -> DataFrame:
    """Add `ts`: the mean label of the rows of the same category that come earlier in the order of a hash of the key, drawn to the overall mean.

    A row never sees its own label. A NULL category is one of its own; a NULL label counts as no row. Rows of one category meet in ranges of
    the hash, so a category that most rows have is no single task.
    """
    from modelyard.operators.ordered import running_totals

    mean = df.agg(F.avg(label)).first()[0] or 0.0
    placed = df.withColumns({"_h": F.xxhash64(F.lit(seed), *key), "_y": F.coalesce(F.col(label).cast("double"), F.lit(0.0)), "_n": F.col(label).isNotNull().cast("long")})
    totals = running_totals(placed, "_h", ["_y", "_n"], [column])
    before = (F.col("cum__y") - F.col("_y") + F.lit(prior_weight * mean)) / (F.col("cum__n") - F.col("_n") + F.lit(prior_weight))
    return totals.withColumn("ts", before).drop("_h", "_y", "_n", "cum__y", "cum__n")
