"""AdaBoost over distributed decision trees. Row weights are a column; only sums of them reach the driver."""

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from modelyard import settings
from modelyard.session import cut_lineage

ROUNDS_PER_CHECKPOINT = 5


class BoostedTrees:
    """Weighted trees; classes vote, numbers take the weighted median."""

    def __init__(self, task: str, trees: list, weights: list[float], classes: int = 0):
        self.task, self.trees, self.weights, self.classes = task, trees, weights, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, []
        for i, tree in enumerate(self.trees):
            part = tree.copy()
            part.setPredictionCol(f"_t{i}")
            if self.task == "classification":
                part.setRawPredictionCol("")
                part.setProbabilityCol("")
            out = part.transform(out)
            names.append(f"_t{i}")
        if self.task == "classification":
            votes = [
                sum((F.when(F.col(n) == float(c), F.lit(w)).otherwise(0.0) for n, w in zip(names, self.weights)), F.lit(0.0))
                for c in range(self.classes)
            ]
            total = sum(self.weights) or 1.0
            shares = F.array(*[v / F.lit(total) for v in votes])
            out = out.withColumn("_shares", shares)
            best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
            out = out.withColumn("prediction", best).withColumn("probability", array_to_vector("_shares"))
            return out.drop("_shares", *names)
        pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("p"), F.lit(w).alias("w")) for n, w in zip(names, self.weights)]))
        half = 0.5 * sum(self.weights)
        walk = F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("p")),
            lambda a, x: F.struct(
                (a["seen"] + x["w"]).alias("seen"),
                F.when(a["p"].isNull() & (a["seen"] + x["w"] >= half), x["p"]).otherwise(a["p"]).alias("p"),
            ),
        )
        return out.withColumn("prediction", walk["p"]).drop(*names)


class _AdaBoost:
    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int | None = None, seed: int = settings.RANDOM_STATE):
        self.rounds, self.rate, self.depth, self.seed = n_estimators, learning_rate, max_depth, seed


    def _rows(self, df: DataFrame) -> DataFrame:
        """Features, label and weight, kept for the rounds; rows that the caller keeps are not kept twice."""
        rows = df.select("features", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w"))
        return rows if df.is_cached else rows.persist()

    def _following(self, rows: DataFrame, r: int) -> DataFrame:
        """Rows of the next round; every few rounds they are written, so that the chain of trees behind a weight stays short."""
        return cut_lineage(rows) if r % ROUNDS_PER_CHECKPOINT == ROUNDS_PER_CHECKPOINT - 1 else rows


class AdaBoostClassifier(_AdaBoost):
    """SAMME: a tree counts by the log odds of its weighted error; missed rows gain weight."""

    def fit(self, df: DataFrame) -> BoostedTrees:
        kept = rows = self._rows(df)
        try:
            return self._grown(rows)
        finally:
            if not df.is_cached:
                kept.unpersist()

    def _grown(self, rows: DataFrame) -> BoostedTrees:
        top, n = rows.agg(F.max("label"), F.count("*")).first()
        k = max(2, int(top) + 1)
        # The trees read the number of classes from the column and need not look for it.
        classes = {"ml_attr": {"type": "nominal", "num_vals": int(top) + 1}}
        rows = rows.withMetadata("label", classes)
        trees, weights = [], []
        for r in range(self.rounds):
            maker = DecisionTreeClassifier(maxDepth=self.depth or 1, weightCol="w", seed=self.seed + r)
            tree = maker.fit(rows)
            # The class straight from the leaf; vectors of votes would be made again for every earlier tree in every pass.
            lean = tree.copy().setRawPredictionCol("").setProbabilityCol("")
            scored = lean.transform(rows).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
            missed, total = scored.agg(F.sum(F.col("w") * F.col("miss")), F.sum("w")).first()
            error = missed / total
            if error >= 1 - 1 / k:
                if not trees:
                    trees, weights = [tree], [1.0]
                break
            if error <= 0:
                trees.append(tree)
                weights.append(1.0)
                break
            alpha = self.rate * (math.log((1 - error) / error) + math.log(k - 1))
            trees.append(tree)
            weights.append(alpha)
            if r == self.rounds - 1:
                break
            # Scale to n, so that weights stay in range over many rounds.
            grown = total + missed * (math.exp(alpha) - 1)
            weight = F.col("w") * F.exp(F.lit(alpha) * F.col("miss")) * F.lit(n / grown)
            rows = self._following(scored.select("features", "label", weight.alias("w")), r).withMetadata("label", classes)
        return BoostedTrees("classification", trees, weights, k)


class AdaBoostRegressor(_AdaBoost):
    """R2 with the linear loss; rows weigh in the trees directly instead of being drawn by weight."""

    def fit(self, df: DataFrame) -> BoostedTrees:
        kept = rows = self._rows(df)
        try:
            return self._grown(rows)
        finally:
            if not df.is_cached:
                kept.unpersist()

    def _grown(self, rows: DataFrame) -> BoostedTrees:
        n = rows.count()
        trees, weights = [], []
        for r in range(self.rounds):
            maker = DecisionTreeRegressor(maxDepth=self.depth or 3, weightCol="w", seed=self.seed + r)
            tree = maker.fit(rows)
            scored = tree.transform(rows).withColumn("gap", F.abs(F.col("prediction") - F.col("label")))
            worst, total, lost = scored.agg(F.max("gap"), F.sum("w"), F.sum(F.col("w") * F.col("gap"))).first()
            if not worst:
                trees.append(tree)
                weights.append(1.0)
                break
            loss = lost / total / worst
            if loss >= 0.5:
                if not trees:
                    trees, weights = [tree], [1.0]
                break
            beta = loss / (1 - loss)
            trees.append(tree)
            weights.append(self.rate * math.log(1 / beta))
            if r == self.rounds - 1:
                break
            weight = F.col("w") * F.pow(F.lit(beta), (1 - F.col("gap") / worst) * self.rate)
            sum_after = scored.agg(F.sum(weight)).first()[0]
            rows = self._following(scored.select("features", "label", (weight * F.lit(n / sum_after)).alias("w")), r)
        return BoostedTrees("regression", trees, weights)
