"""Model search: seeded random trials, k-fold scores, early stop, and the trial table."""

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from math import exp, log

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from modelyard import settings
from modelyard.operators.clustering import silhouette_squared
from modelyard.operators.models import FACTORIES, estimator
from modelyard.operators.ordered import running_max, trailing
from modelyard.operators.split import hash_folds
from modelyard.session import balanced

# Parameter ranges. (low, high) whole numbers, ("float", low, high), ("log", low, high).
FOREST = {"n_estimators": (50, 300), "max_depth": (3, 20), "min_samples_split": (2, 20), "min_samples_leaf": (1, 10)}
RANGES = {
    "random_forest": FOREST,
    "xgboost": {
        "n_estimators": (50, 300),
        "max_depth": (3, 12),
        "learning_rate": ("log", 1e-3, 0.1),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
    },
    "lightgbm": {
        "n_estimators": (50, 300),
        "num_leaves": (20, 100),
        "learning_rate": ("log", 1e-3, 0.1),
        "feature_fraction": ("float", 0.6, 1.0),
        "bagging_fraction": ("float", 0.6, 1.0),
    },
    "catboost": {
        "iterations": (50, 300),
        "depth": (3, 10),
        "learning_rate": ("log", 1e-3, 0.1),
        "l2_leaf_reg": ("log", 1e-8, 10.0),
    },
    "linear_svc": {"C": ("log", 1e-3, 100.0)},
}


def draw_params(name: str, rng: random.Random, ranges: dict | None = None) -> dict:
    """One random setting of a model."""
    out = {}
    for parameter, spec in (ranges or RANGES).get(name, {}).items():
        if spec[0] == "log":
            out[parameter] = exp(rng.uniform(log(spec[1]), log(spec[2])))
        elif spec[0] == "float":
            out[parameter] = rng.uniform(spec[1], spec[2])
        else:
            out[parameter] = rng.randint(*spec)
    return out


def draw_trials(task: str, n: int, seed: int, names: Sequence[str] | None = None, ranges: dict | None = None) -> list[tuple]:
    """`n` random (model, parameters) pairs."""
    rng = random.Random(seed)
    pool = list(names or FACTORIES[task])
    return [(name, draw_params(name, rng, ranges)) for name in (rng.choice(pool) for _ in range(n))]


def score(model, df: DataFrame, task: str) -> float:
    """Accuracy, negative mean squared error, silhouette, or share of variance kept."""
    if task == "dimensionality_reduction":
        return float(sum(model.explained_ratio)) if hasattr(model, "explained_ratio") else _variance_kept(model, df)
    scored = model.transform(df)
    if task == "classification":
        return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    if task == "regression":
        gap = F.col("prediction") - F.col("label")
        return -scored.agg(F.avg(gap * gap)).first()[0]
    return silhouette_squared(scored, "features", "prediction").first()[0]


def _variance_kept(model, df: DataFrame) -> float:
    """Share of the feature variance that a linear map of the reduced rows explains."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from modelyard.functions.vectors import as_array, pack_sums

    out = model.transform(df)
    column = "reduced" if "reduced" in out.columns else "topicDistribution"
    both = out.select(F.lit(0).alias("g"), as_array(out, "features").alias("x"), vector_to_array(column).alias("z"))
    first = both.first()
    p = len(first["x"])
    n, total, cross = pack_sums(both.select("g", F.concat("x", "z").alias("v")), "g", "v", [*first["x"], *first["z"]])[0]
    scatter = cross - np.outer(total, total) / n
    xx, xz, zz = scatter[:p, :p], scatter[:p, p:], scatter[p:, p:]
    return float(np.trace(xz @ np.linalg.pinv(zz) @ xz.T) / np.trace(xx))


def cross_validate(df: DataFrame, make: Callable[[], object], task: str, parallelism: int = 2) -> float:
    """Mean score over the values of `fold`: fit on the others, score on the one. Folds are fitted side by side."""
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())

    def one(i: int) -> float:
        train, test = df.where(F.col("fold") != i), df.where(F.col("fold") == i)
        return score(make().fit(train), test, task)

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds))
    return sum(scores) / len(scores)


def has_settled(values: Sequence[float], patience: int = settings.PATIENCE, min_delta: float = settings.MIN_DELTA) -> bool:
    """Whether the last `patience` values are all within `min_delta` of the best of them."""
    last = list(values)[-patience:]
    return len(last) == patience and max(last) - min(last) < min_delta


def search(
    df: DataFrame,
    task: str,
    key: Sequence[str] | None = None,
    n_trials: int = settings.N_TRIALS,
    timeout: float = settings.SEARCH_TIMEOUT_SECONDS,
    names: Sequence[str] | None = None,
    ranges: dict | None = None,
    folds: int = settings.CV_FOLDS,
    seed: int = settings.RANDOM_STATE,
    patience: int = settings.PATIENCE,
    min_delta: float = settings.MIN_DELTA,
    parallelism: int = 2,
) -> dict:
    """Try models until trials, time or patience run out; refit the best on all rows.

    `df` has `features`, `label` where the task has one, and either `fold` or the key columns to draw folds by. The
    trial list is short, so it stays on the driver; every fit and score is a distributed job. A trial that fails is a trial with an
    `error` and no value, and the search goes on; only a search without any finished trial is an error. The jobs of a trial carry a
    tag, which is cancelled when the time is up, so one slow trial cannot hold the search: it counts as failed.
    """
    rows = df if "fold" in df.columns else hash_folds(df, key, folds, seed)
    rows = balanced(rows).persist()
    context = df.sparkSession.sparkContext
    trials, started = [], time.monotonic()
    try:
        for number, (name, params) in enumerate(draw_trials(task, n_trials, seed, names, ranges)):
            trial = {"trial": number, "model": name, "params": params, "value": None, "started": time.time(), "error": None}
            with _deadline(context, f"search-{uuid.uuid4().hex}", timeout - (time.monotonic() - started)):
                try:
                    trial["value"] = _finite(cross_validate(rows, lambda: estimator(name, task, **params), task, parallelism))
                except Exception as problem:  # noqa: BLE001
                    trial["error"] = f"{type(problem).__name__}: {problem}".split("\n")[0][:500]
            trials.append(trial)
            values = [t["value"] for t in trials if t["error"] is None]
            if has_settled(values, patience, min_delta) or time.monotonic() - started > timeout:
                break
        finished = [t for t in trials if t["error"] is None]
        if not finished:
            raise RuntimeError("no trial has finished: " + "; ".join(f"{t['model']}: {t['error']}" for t in trials))
        best = max(finished, key=lambda t: t["value"])
        model = estimator(best["model"], task, **best["params"]).fit(rows)
    finally:
        rows.unpersist()
    return {"model": model, "best": best, "trials": trials}


def _finite(value: float | None) -> float:
    if value is None or value != value:
        raise ValueError("the score is no number")
    return value


@contextmanager
def _deadline(context: SparkContext, tag: str, seconds: float) -> Iterator[None]:
    """Jobs started inside carry `tag` and are cancelled after `seconds`."""
    timer = threading.Timer(max(0.0, seconds), lambda: context.cancelJobsWithTag(tag))
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def trial_table(spark: SparkSession, trials: Sequence[dict]) -> DataFrame:
    """Trials as rows; a failed one has no value and says why."""
    rows = [(t["trial"], t["model"], json.dumps(t["params"], sort_keys=True), t["value"], t["error"], t["started"]) for t in trials]
    df = spark.createDataFrame(rows, "trial long, model string, params string, value double, error string, started double")
    return df.withColumn("started", F.timestamp_seconds("started"))


def best_so_far(trials: DataFrame, study: Sequence[str] = (), order: str = "trial") -> DataFrame:
    return running_max(trials, "value", order, study)


def settled_at(
    trials: DataFrame,
    study: Sequence[str],
    order: str = "trial",
    patience: int = settings.PATIENCE,
    min_delta: float = settings.MIN_DELTA,
) -> DataFrame:
    """Add `settled`: whether the search of a study could stop at this trial."""
    outputs = {"_n": F.count("value"), "_hi": F.max("value"), "_lo": F.min("value")}
    found = trailing(trials, order, study, patience, outputs)
    settled = (F.col("_n") == patience) & (F.col("_hi") - F.col("_lo") < min_delta)
    return found.withColumn("settled", settled).drop("_n", "_hi", "_lo")
