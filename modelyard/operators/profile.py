"""Guards, column typing, missing counts, table profile and value counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from modelyard.functions.values import is_missing

NUMERIC_TYPES = (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)


def require_rows(df: DataFrame) -> DataFrame:
    """Reject an empty table."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The names in `columns` that `df` lacks."""
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reject a table that lacks one of `columns`; the message names what is missing."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_roles(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Columns by role: numeric, categorical and dropped (bytes, dates, times and nested types)."""
    roles: dict[str, list[str]] = {"numeric": [], "categorical": [], "dropped": []}
    for field in df.schema.fields:
        if field.name == target:
            continue
        if isinstance(field.dataType, NUMERIC_TYPES):
            roles["numeric"].append(field.name)
        elif isinstance(field.dataType, CATEGORICAL_TYPES):
            roles["categorical"].append(field.name)
        else:
            roles["dropped"].append(field.name)
    return roles


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The features and the target as two projections of one table."""
    require_columns(df, [target])
    return df.drop(target), df.select(target)


def infer_task(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """Classification for text, booleans and few whole numbers; regression otherwise (our rule)."""
    require_columns(df, [target])
    kind = df.schema[target].dataType
    if isinstance(kind, CATEGORICAL_TYPES):
        return "classification"
    value = F.col(f"`{target}`").cast("double")
    row = df.agg(
        F.approx_count_distinct(value, 0.02).alias("classes"),
        F.max((value != F.floor(value)).cast("int")).alias("fractional"),
    ).first()
    return "classification" if not row["fractional"] and row["classes"] <= max_classes else "regression"


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: missing and total rows, from a single pass."""
    columns = df.columns
    sums = [F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(columns)]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), F.col("rows"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(F.count("*").alias("rows"), *sums).select(F.inline(entries))


def profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Name, type, role and missing count of every column."""
    roles = column_roles(df, target)
    role_of = {c: role for role, names in roles.items() for c in names}
    facts = F.create_map(
        *[
            F.lit(x)
            for f in df.schema.fields
            for x in (f.name, f"{f.dataType.simpleString()}|{role_of.get(f.name, 'target')}")
        ]
    )
    fact = F.element_at(facts, F.col("column_name"))
    return missing_counts(df).select(
        "column_name",
        F.substring_index(fact, "|", 1).alias("data_type"),
        F.substring_index(fact, "|", -1).alias("role"),
        "missing",
        "rows",
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, for a look at a table."""
    return df.limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value; NULL is left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))
