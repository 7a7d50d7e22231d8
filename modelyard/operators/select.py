"""Feature selection: scores per feature as tables, and the chosen names."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard import settings
from modelyard.functions.stats import chi_square_tail, f_tail
from modelyard.functions.values import nan_to_null
from modelyard.operators.drift import bin_number
from modelyard.operators.profile import column_roles


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 20) -> DataFrame:
    """Mutual information (nats) of every feature with the label, from one contingency table in one melted pass.

    Numeric features with fractional types are cut into equal-width bins; whole numbers and text count as categories.
    NULL and NaN are left out.
    """
    features = list(features)
    df = nan_to_null(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    real = [c for c in features if kinds[c] in ("double", "float") or kinds[c].startswith("decimal")]
    edges = {}
    if real:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(real) for p, f in (("lo", F.min), ("hi", F.max))]).first()
        edges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(real)}
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.when(F.col(c).isNotNull(), bin_number(F.col(c).cast("double"), *edges[c], bins) if c in edges else F.col(c)).cast("string").alias("x"),
        )
        for c in features
    ]
    cells = (
        df.select(F.col(label).cast("string").alias("y"), F.inline(F.array(*entries)))
        .where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("feature", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    by_x = cells.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    by_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    whole = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = cells.join(by_x, ["feature", "x"]).join(by_y, ["feature", "y"]).join(whole, "feature")
    n, nx, ny, total = (F.col(c).cast("double") for c in ("n", "nx", "ny", "total"))
    return joined.groupBy("feature").agg(F.sum(n / total * F.log(n * total / (nx * ny))).alias("score"))


def _class_sums(df: DataFrame, features: Sequence[str], label: str) -> list:
    """Count, sum and squared deviations of every feature per class: k rows. Missing values and labels are left out."""
    cells = []
    for i, c in enumerate(features):
        value = _number(c)
        squares = F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0))
        cells += [F.count(value).alias(f"n{i}"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"s{i}"), squares.alias(f"q{i}")]
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y")).agg(*cells).collect()


def _number(name: str) -> Column:
    """A column as a number, NULL for NaN."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of non-negative feature totals per class against the class shares, with k - 1 degrees of freedom."""
    classes = _class_sums(df, features, label)
    out = []
    for i, c in enumerate(features):
        rows = [(r[f"n{i}"], r[f"s{i}"]) for r in classes if r[f"n{i}"]]
        n, total = sum(m for m, _ in rows), sum(s for _, s in rows)
        score = sum((s - total * m / n) ** 2 / (total * m / n) for m, s in rows) if total else 0.0
        out.append((c, float(score), chi_square_tail(score, len(rows) - 1) if len(rows) > 1 else 1.0))
    return df.sparkSession.createDataFrame(out, "feature string, score double, p_value double")


def anova_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of every feature between the classes that have values; NULL where fewer than two have, or no spare row."""
    classes = _class_sums(df, features, label)
    out: list[tuple] = []
    for i, c in enumerate(features):
        rows = [(r[f"n{i}"], r[f"s{i}"], r[f"q{i}"]) for r in classes if r[f"n{i}"]]
        n, k = sum(m for m, _, _ in rows), len(rows)
        if k < 2 or n <= k:
            out.append((c, None, None))
            continue
        mean = sum(s for _, s, _ in rows) / n
        between = sum(m * (s / m - mean) ** 2 for m, s, _ in rows) / (k - 1)
        within = sum(q for _, _, q in rows) / (n - k)
        score = between / within if within else float("inf")
        out.append((c, float(score), f_tail(score, k - 1, n - k)))
    return df.sparkSession.createDataFrame(out, "feature string, score double, p_value double")


def regression_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """F of the one-feature regression of the label, from the correlation over rows where both have a value.

    NULL where fewer than three rows have both.
    """
    value = _number(label)
    cells = []
    for i, c in enumerate(features):
        x, y = F.when(value.isNotNull(), _number(c)), F.when(_number(c).isNotNull(), value)
        cells += [F.count(x).alias(f"n{i}"), F.corr(x, y).alias(f"r{i}")]
    row = df.agg(*cells).first()
    out: list[tuple] = []
    for i, c in enumerate(features):
        r, free = row[f"r{i}"], row[f"n{i}"] - 2
        if free < 1:
            out.append((c, None, None))
            continue
        score = r * r / (1 - r * r) * free if r is not None and abs(r) < 1 else float("inf")
        out.append((c, float(score), f_tail(score, 1, free)))
    return df.sparkSession.createDataFrame(out, "feature string, score double, p_value double")


def select_k_best(scores: DataFrame, k: int = settings.K_BEST) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


def select_percentile(scores: DataFrame, percentile: float = 10) -> DataFrame:
    """The best `percentile` percent of the features, one at least."""
    n = scores.count()
    return select_k_best(scores, max(1, int(n * percentile / 100)))


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Population variance of every feature."""
    row = df.agg(*[F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("score")) for i, c in enumerate(features)]))
    )


def variance_threshold(df: DataFrame, features: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Features whose variance is above the threshold."""
    return variances(df, features).where(F.col("score") > threshold)


def select_from_model(importance: DataFrame, threshold: float | None = None) -> DataFrame:
    """Features at or above the threshold; the mean importance by default."""
    if threshold is not None:
        return importance.where(F.col("importance_score") >= threshold)
    mean = importance.agg(F.avg("importance_score")).scalar()
    return importance.where(F.col("importance_score") >= mean)


def eliminate(features: Sequence[str], fit_importance: Callable[[list[str]], dict[str, float]], keep: int, step: int = 1) -> list:
    """Recursive elimination: fit, drop the `step` least important features, until `keep` are left.

    `fit_importance` fits a distributed model on the given features. Returns (feature, rank), rank 1 = kept.
    """
    left = list(features)
    dropped: list[list[str]] = []
    while len(left) > keep:
        weight = fit_importance(left)
        out = sorted(left, key=lambda c: (weight[c], c))[: min(step, len(left) - keep)]
        left = [c for c in left if c not in out]
        dropped.append(out)
    ranks = [(c, 1) for c in left]
    return ranks + [(c, i + 2) for i, group in enumerate(reversed(dropped)) for c in group]


def numeric_features(df: DataFrame, label: str) -> list[str]:
    return column_roles(df, label)["numeric"]
