"""The registered queries: a name, a function from the given tables to a DataFrame, and SQL that means the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from modelyard.session import apply_runtime_settings

QUERIES: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """The given Parquet tables as attributes; zone-less times become timestamps (the session zone is UTC)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_runtime_settings(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; without `sql` only its rows are checked."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = (function, sql)
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column, so that two engines agree on the last digits."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in skip
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def load_all() -> dict[str, tuple[Callable, str | None]]:
    """Import every query module and return the registry."""
    from modelyard.plans import (  # noqa: F401
        queries_alerts,
        queries_drift,
        queries_evaluation,
        queries_history,
        queries_models,
        queries_prep,
        queries_profile,
        queries_streams,
    )

    return QUERIES
