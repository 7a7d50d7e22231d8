"""Casts, JSON, map access and hashes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean "missing"; keep only NULL."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for a floating column."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def to_number(column: Column) -> Column:
    """A number, or NULL when the text is none."""
    return column.cast("string").try_cast("double")


def pick_metric(metrics: Column, *names: str) -> Column:
    """The first named metric that is present, else 0."""
    names = names or ("accuracy", "r2")
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names], F.lit(0.0))


def sorted_json(mapping: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def row_json(columns: Sequence[str]) -> Column:
    """One row as JSON text, fields in the given order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def fingerprint(columns: Sequence[str]) -> Column:
    """A content key of a row: SHA-256 of its JSON, fields in name order."""
    return F.sha2(row_json(sorted(columns)), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row that changes with the content of a table but not with its row order."""
    # A hash skips NULLs, so whether each value is one is hashed as well.
    columns = [part for c in sorted(df.columns) for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.select(F.xxhash64(*columns).alias("h")).agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("digest")
    )
