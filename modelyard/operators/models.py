"""Model factories by name. Spark ML estimators where one exists, small distributed fits elsewhere.

All take a table with `features` (vector) and `label` (double, 0..k-1 for classes) and give a model with `transform`.
"""

from collections.abc import Callable

from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, functions as F

from modelyard import settings
from modelyard.operators.boosting import AdaBoostClassifier, AdaBoostRegressor
from modelyard.operators.decomposition import FastICA, NonNegativeFactors, PrincipalComponents, SingularVectors
from modelyard.operators.grower import ExtraTrees, SecondOrderBoosting
from modelyard.operators.linear import LinearDiscriminant, RidgeVotes
from modelyard.operators.neighbours import NearestNeighbours
from modelyard.operators.partitioning import MiniBatchCentres, TableClusters

SEED = settings.RANDOM_STATE


class Sized:
    """An estimator whose settings depend on the data: rows, classes, width and label deviation, from one aggregate."""

    def __init__(self, make: Callable[[int, int, int, float], object]):
        self.make = make

    def fit(self, df: DataFrame):
        from modelyard.functions.vectors import as_array

        row = df.select("label", F.size(as_array(df, "features")).alias("_p")).agg(
            F.count("*").alias("n"),
            F.max("label").alias("top"),
            F.max("_p").alias("p"),
            F.stddev_pop("label").alias("spread"),
        ).first()
        if not row["n"]:
            raise ValueError("the table is empty")
        return self.make(row["n"], int(row["top"]) + 1, row["p"], row["spread"]).fit(df)


def _tree_options(p: dict, trees: str) -> dict:
    """Parameter names of the search ranges as Spark names."""
    names = {
        "n_estimators": trees,
        "max_depth": "maxDepth",
        "learning_rate": "stepSize",
        "subsample": "subsamplingRate",
        "min_samples_leaf": "minInstancesPerNode",
    }
    out = {}
    for name, value in p.items():
        if name in names:
            out[names[name]] = value
        elif name == "min_samples_split":
            # A node that may be split holds at least this many rows: half of it on each side.
            out["minInstancesPerNode"] = max(out.get("minInstancesPerNode", 1), (value + 1) // 2)
        elif name == "num_leaves":
            out["maxDepth"] = max(1, (int(value) - 1).bit_length())
        else:
            out[name] = value
    return out


def _boosted(defaults: dict, task: str) -> Callable:
    def build(p: dict):
        options = {"seed": SEED, **_tree_options({**defaults, **p}, "maxIter")}
        if task == "regression":
            return R.GBTRegressor(**options)
        one = C.GBTClassifier(**options)
        return Sized(lambda n, k, width, spread: one if k <= 2 else C.OneVsRest(classifier=one))

    return build


def _forest(kind) -> Callable:
    def build(p: dict):
        return kind(seed=SEED, **_tree_options({"n_estimators": 100, "max_depth": 10, **p}, "numTrees"))

    return build


def _svc(regularisation: Callable[[dict, int], float]) -> Callable:
    def build(p: dict):
        def make(n, k, width, spread):
            one = C.LinearSVC(
                regParam=regularisation(p, n), standardization=False, maxIter=p.get("max_iter", 100), tol=p.get("tol", 1e-4)
            )
            return one if k <= 2 else C.OneVsRest(classifier=one)

        return Sized(make)

    return build


def _linear(penalty: Callable[[dict, int], float], ratio: Callable[[dict], float]) -> Callable:
    """Least squares with penalty * (ratio * |w| + (1 - ratio) / 2 * w^2) on half the mean squared error.

    Spark scales the label to deviation 1 inside, which leaves the absolute part as it is and divides the square part
    by the deviation; the settings undo that.
    """

    def build(p: dict):
        def make(n, k, width, spread):
            absolute = penalty(p, n) * ratio(p)
            square = penalty(p, n) * (1 - ratio(p)) * spread
            whole = absolute + square
            return R.LinearRegression(
                regParam=whole,
                elasticNetParam=absolute / whole if whole else 0.0,
                standardization=False,
                maxIter=p.get("max_iter", 100),
            )

        return Sized(make)

    return build


# Names of the search ranges as those of the growers.
GROWER_NAMES = {
    "iterations": "n_estimators", "depth": "max_depth", "num_leaves": "max_leaves", "l2_leaf_reg": "l2", "reg_lambda": "l2",
    "colsample_bytree": "columns", "feature_fraction": "columns", "bagging_fraction": "subsample", "min_child_samples": "least_rows",
}


def _second_order(style: str, task: str) -> Callable:
    def build(p: dict):
        options = {GROWER_NAMES.get(name, name): value for name, value in p.items()}
        if style == "level":
            # Slow steps for many rounds, larger ones for few.
            options.setdefault("learning_rate", min(0.5, 3.0 / options.get("n_estimators", 100)))
        return SecondOrderBoosting(task, style, **options)

    return build


# First-order boosting: Spark's trees on the gradient.
GRADIENT = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}
HISTOGRAM = {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31}

FACTORIES: dict[str, dict[str, Callable[[dict], object]]] = {
    "classification": {
        # Penalty 1/C on the sum of losses is 1/(C n) on their mean.
        "logistic_regression": lambda p: Sized(
            lambda n, k, width, spread: C.LogisticRegression(
                regParam=1.0 / (p.get("C", 1.0) * n), standardization=False, maxIter=p.get("max_iter", 1000)
            )
        ),
        "random_forest": _forest(C.RandomForestClassifier),
        "gradient_boosting": _boosted(GRADIENT, "classification"),
        "hist_gradient_boosting": _boosted(HISTOGRAM, "classification"),
        "extra_trees": lambda p: ExtraTrees("classification", **p),
        "ada_boost": lambda p: AdaBoostClassifier(**p),
        "linear_svc": _svc(lambda p, n: 1.0 / (p.get("C", 1.0) * n)),
        "knn": lambda p: NearestNeighbours(task="classification", **p),
        "decision_tree": lambda p: C.DecisionTreeClassifier(seed=SEED, **_tree_options({"max_depth": 10, **p}, "")),
        "mlp": lambda p: Sized(
            lambda n, k, width, spread: C.MultilayerPerceptronClassifier(
                layers=[width, *p.get("hidden", [100]), max(2, k)], maxIter=p.get("max_iter", 200), seed=SEED
            )
        ),
        "gaussian_nb": lambda p: C.NaiveBayes(modelType="gaussian", **p),
        # Needs features >= 0, which scaled input is not.
        "multinomial_nb": lambda p: C.NaiveBayes(modelType="multinomial", smoothing=p.get("alpha", 1.0)),
        "lda": lambda p: LinearDiscriminant(**p),
        "ridge": lambda p: RidgeVotes(**p),
        "sgd": _svc(lambda p, n: p.get("alpha", 1e-4)),
        "xgboost": _second_order("depth", "classification"),
        "lightgbm": _second_order("leaf", "classification"),
        "catboost": _second_order("level", "classification"),
    },
    "regression": {
        "linear_regression": lambda p: R.LinearRegression(regParam=0.0, **p),
        "ridge": _linear(lambda p, n: p.get("alpha", 1.0) / n, lambda p: 0.0),
        "lasso": _linear(lambda p, n: p.get("alpha", 1.0), lambda p: 1.0),
        "elastic_net": _linear(lambda p, n: p.get("alpha", 1.0), lambda p: p.get("l1_ratio", 0.5)),
        "random_forest": _forest(R.RandomForestRegressor),
        "gradient_boosting": _boosted(GRADIENT, "regression"),
        "hist_gradient_boosting": _boosted(HISTOGRAM, "regression"),
        "extra_trees": lambda p: ExtraTrees("regression", **p),
        "ada_boost": lambda p: AdaBoostRegressor(**p),
        "knn": lambda p: NearestNeighbours(task="regression", **p),
        "decision_tree": lambda p: R.DecisionTreeRegressor(seed=SEED, **_tree_options({"max_depth": 10, **p}, "")),
        "sgd": _linear(lambda p, n: p.get("alpha", 1e-4), lambda p: 0.0),
        "xgboost": _second_order("depth", "regression"),
        "lightgbm": _second_order("leaf", "regression"),
        "catboost": _second_order("level", "regression"),
    },
    "clustering": {
        "kmeans": lambda p: K.KMeans(k=p.get("n_clusters", 8), seed=SEED, maxIter=p.get("max_iter", 20)),
        # Divisive; `agglomerative` is single linkage.
        "hierarchical": lambda p: K.BisectingKMeans(k=p.get("n_clusters", 2), seed=SEED),
        "agglomerative": lambda p: TableClusters("agglomerative", **{"n_clusters": 2, **p}),
        "dbscan": lambda p: TableClusters("dbscan", **{"eps": 0.5, **p}),
        "spectral": lambda p: TableClusters("spectral", **{"n_clusters": 8, **p}),
        "minibatch_kmeans": lambda p: MiniBatchCentres(**p),
    },
    "dimensionality_reduction": {
        "pca": lambda p: PrincipalComponents(**p),
        "truncated_svd": lambda p: SingularVectors(**p),
        "fast_ica": lambda p: FastICA(**p),
        "nmf": lambda p: NonNegativeFactors(**p),
        "lda": lambda p: K.LDA(k=p.get("n_components", 10), maxIter=p.get("max_iter", 10), seed=SEED),
    },
}

def model_names(task: str) -> list[str]:
    if task not in FACTORIES:
        raise ValueError(f"unknown task {task}")
    return list(FACTORIES[task])


def estimator(name: str, task: str, **params):
    """The estimator called `name` for a task."""
    if task not in FACTORIES:
        raise ValueError(f"unknown task {task}")
    if name not in FACTORIES[task]:
        raise ValueError(f"no {task} model {name}; there are {', '.join(model_names(task))}")
    return FACTORIES[task][name](params)
