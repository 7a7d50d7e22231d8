"""Categories to numbers. Category lists are parameters of a model, so they must fit one; the limit is checked."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MISSING = "missing"
OTHER = "__other__"
CATEGORY_LIMIT = 100_000


def filled(column: str) -> Column:
    """A category as text, `missing` for NULL."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


def categories(df: DataFrame, columns: Sequence[str], limit: int = CATEGORY_LIMIT) -> dict[str, list[str]]:
    """The sorted categories of every column, in one job. More than `limit` in all is an error, never a cut."""
    entries = [F.struct(F.lit(c).alias("column_name"), filled(c).alias("category")) for c in columns]
    if not entries:
        return {}
    found = df.select(F.inline(F.array(*entries))).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories: group rare ones or leave such columns out")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        out[row["column_name"]].append(row["category"])
    return {c: sorted(v) for c, v in out.items()}


def frequent_categories(df: DataFrame, column: str, keep: int) -> list[str]:
    """The `keep` most frequent categories; ties by name."""
    counts = df.groupBy(filled(column).alias("category")).agg(F.count("*").alias("n"))
    return [r["category"] for r in counts.orderBy(F.col("n").desc(), "category").limit(keep).collect()]


def group_rare(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Categories outside `keep` become `__other__`."""
    value = filled(column)
    return df.withColumn(column, F.when(value.isin(*keep), value).otherwise(F.lit(OTHER)))


def one_hot_names(fitted: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, values in fitted.items() for v in values[1:]]


def one_hot_cells(fitted: dict[str, list[str]]) -> list[Column]:
    """0/1 columns of all categories but the first; an unseen category is all zeros."""
    return [
        (filled(c) == F.lit(v)).cast("double").alias(f"{c}_{v}") for c, values in fitted.items() for v in values[1:]
    ]


def one_hot(df: DataFrame, fitted: dict[str, list[str]], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *one_hot_cells(fitted))


def label_table(df: DataFrame, label: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """(value, code) with codes 0..k-1 in the sort order of the label type."""
    values = df.select(label).where(F.col(label).isNotNull()).distinct().limit(limit + 1).collect()
    if len(values) > limit:
        raise ValueError(f"more than {limit} classes")
    coded = [(v, float(i)) for i, v in enumerate(sorted(r[0] for r in values))]
    return df.sparkSession.createDataFrame(
        coded, f"`{label}` {df.schema[label].dataType.simpleString()}, code double"
    )


def label_encode(df: DataFrame, label: str, table: DataFrame | None = None, output: str = "label") -> DataFrame:
    """Replace class values by their codes. The class table was checked against the limit, so it may be broadcast."""
    table = label_table(df, label) if table is None else table
    coded = df.join(F.broadcast(table), label, "left")
    return coded.drop(label).withColumnRenamed("code", output) if output == label else coded.withColumnRenamed("code", output)


def ordinal_encode(df: DataFrame, columns: Sequence[str], fitted: dict[str, list[str]] | None = None) -> DataFrame:
    """Every category as its place in the sort order; NULL for an unseen one."""
    fitted = categories(df, columns) if fitted is None else fitted
    out = {}
    for c in columns:
        places = F.array(*[F.lit(v) for v in fitted[c]])
        place = F.array_position(places, filled(c))
        out[c] = F.when(place > 0, (place - 1).cast("double"))
    return df.withColumns(out)
