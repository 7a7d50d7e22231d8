"""The fitted feature preparation: numeric and categorical branches, one feature vector, names that match it."""

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from modelyard import settings
from modelyard.functions.values import is_missing
from modelyard.operators import encode, impute, scale
from modelyard.operators.profile import column_roles, require_columns, require_rows


@dataclass
class Prepared:
    """Everything a fit has learnt, as plain values."""

    numeric: list[str]
    categorical: list[str]
    dropped: list[str]
    target: str | None
    task: str
    fill: dict
    scaler: dict
    categories: dict
    classes: list = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *encode.one_hot_names(self.categories)]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep`, `features`, and `label` where the target is present. New data goes through the fitted state."""
        require_columns(df, [*self.numeric, *self.categorical])
        fill = impute.IterativeFill(**self.fill)
        rest = [c for c in df.columns if c not in self.numeric]
        rows = df.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{c}`").cast("double").alias(c) for c in self.numeric])
        rows = fill.transform(rows) if self.numeric else rows
        rows = scale.apply_scaler(rows, {c: tuple(v) for c, v in self.scaler.items()})
        cells = [F.col(f"`{c}`") for c in self.numeric] + encode.one_hot_cells(self.categories)
        out = [F.col(f"`{c}`") for c in keep]
        if self.target and self.target in df.columns:
            if self.task == "classification":
                table = encode_table(df, self.target, self.classes)
                rows = rows.join(F.broadcast(table), self.target, "left")
                out.append(F.col("code").alias("label"))
            else:
                out.append(F.col(f"`{self.target}`").cast("double").alias("label"))
        return rows.select(*out, array_to_vector(F.array(*cells)).alias("features"))

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @staticmethod
    def from_json(text: str) -> "Prepared":
        state = json.loads(text)
        state["fill"]["steps"] = [tuple(s) for s in state["fill"]["steps"]]
        return Prepared(**state)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Prepared":
        return Prepared.from_json(spark.read.text(path).first()["value"])


def encode_table(df: DataFrame, target: str, classes: Sequence) -> DataFrame:
    kind = df.schema[target].dataType.simpleString()
    return df.sparkSession.createDataFrame(
        [(c, float(i)) for i, c in enumerate(classes)], f"`{target}` {kind}, code double"
    )


def fit_preparation(
    df: DataFrame,
    target: str | None,
    task: str,
    ignore: Sequence[str] = (),
    imputer: str = "iterative",
    scaler: str = "robust",
    max_categories: int | None = None,
) -> Prepared:
    """Learn imputation, scaling, categories and classes. Dropped columns are reported in the result.

    With `max_categories` only the most frequent categories of a column get a place of their own; without it all do.
    """
    require_rows(df)
    if target is not None:
        require_columns(df, [target])
    if task not in settings.TASKS:
        raise ValueError(f"unknown task {task}")
    roles = column_roles(df.drop(*ignore), target)
    numeric, categorical, dropped = roles["numeric"], roles["categorical"], roles["dropped"]
    # A column without any number has nothing to learn from; it is dropped and reported, as are others that are no features.
    seen = df.agg(F.lit(1), *[F.count(F.when(~is_missing(df, c), 1)) for c in numeric]).first()[1:]
    dropped = [*dropped, *[c for c, n in zip(numeric, seen) if not n]]
    numeric = [c for c, n in zip(numeric, seen) if n]
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
    if imputer == "iterative" and numeric:
        fill = impute.fit_iterative(numbers, numeric)
    elif not numeric:
        fill = impute.IterativeFill([], [], [])
    else:
        strategy = "mean" if imputer == "iterative" else imputer
        simple = impute.fit_simple(numbers, numeric, strategy)
        fill = impute.IterativeFill(numeric, [simple[c] for c in numeric], [])
    scaled = scale.fit_scaler(fill.transform(numbers) if numeric else numbers, numeric, scaler) if numeric else {}
    if max_categories:
        groups = {c: sorted(encode.frequent_categories(df, c, max_categories)) for c in categorical}
    else:
        groups = encode.categories(df, categorical)
    classes = []
    if task == "classification" and target is not None:
        classes = [r[0] for r in encode.label_table(df, target).orderBy("code").collect()]
    return Prepared(numeric, categorical, dropped, target, task, asdict(fill), scaled, groups, classes)
