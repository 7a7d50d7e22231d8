"""Reading tables: formats by extension, CSV encoding and delimiter, size guard."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelyard import settings
from modelyard.functions.values import nan_to_null

# Encodings tried in order, with the names Spark knows them by.
ENCODINGS = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "latin1": "ISO-8859-1",
    "cp1256": "windows-1256",
    "iso-8859-1": "ISO-8859-1",
}

DELIMITERS = [",", ";", "\t", "|"]
READABLE = {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json"}


def file_format(path: str) -> str:
    """The format of a path by its extension; anything unsupported is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension not in READABLE:
        raise ValueError(f"unsupported file type: {name}; convert it to CSV, Parquet or JSON")
    return READABLE[extension]


def check_size(spark: SparkSession, path: str, limit: int | None = settings.MAX_FILE_BYTES) -> int:
    """Total bytes under a path; more than `limit` is an error, unless the limit is None."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    if limit is not None and total > limit:
        raise ValueError(f"input of {total} bytes is above the limit of {limit}")
    return total


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes every line.

    All lines are tried, distributed. The one-byte encodings accept any byte, so the first of them is the answer when
    some line is no valid UTF-8.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "utf-8" if bad.isEmpty() else "latin1"


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The delimiter with which most lines have as many fields as the first one; the fuller one on a tie.

    All lines are counted, in one distributed aggregate.
    """
    lines = spark.read.option("encoding", ENCODINGS[encoding]).text(path).where("value <> ''")
    counts = lines.select(*[_fields(F.col("value"), mark).alias(f"f{i}") for i, mark in enumerate(DELIMITERS)])
    first = counts.first()
    if first is None:
        return ","
    same = counts.agg(*[F.sum((F.col(f"f{i}") == n).cast("long")) for i, n in enumerate(first)]).first()
    # Every mark is judged on the same lines, so numbers of lines compare as their shares do.
    best, best_score = ",", (-1, 0)
    for mark, steady, fields in zip(DELIMITERS, same, first):
        if fields >= 2 and (steady, fields) > best_score:
            best, best_score = mark, (steady, fields)
    return best


def _fields(line: Column, mark: str) -> Column:
    """Fields of a line; a mark inside quotes does not count."""
    bare = F.regexp_replace(line, '"[^"]*"?', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit(""))) + 1


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, schema=None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; encoding, delimiter and types are found out where they are not given.

    With a schema there is no pass over the data before the real one, which is the way to read a large input.
    """
    encoding = encoding or detect_encoding(spark, path)
    delimiter = delimiter or detect_delimiter(spark, path, encoding)
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", ENCODINGS[encoding])
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    clean = [c.lstrip("﻿") for c in df.columns]
    return df if clean == df.columns else df.toDF(*clean)


def read_table(spark: SparkSession, path: str, max_bytes: int | None = None, schema=None, **options) -> DataFrame:
    """Any supported table, NaN as NULL. The size limit is optional, as inputs here are large."""
    kind = file_format(path)
    if max_bytes is not None:
        check_size(spark, path, max_bytes)
    if kind == "csv":
        return nan_to_null(read_csv(spark, path, schema=schema, **options))
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.format(kind).load(path))


def read_rows(spark: SparkSession, documents: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON documents (one object or a list of objects per row) as rows of `schema`."""
    text = F.trim(F.col(column))
    wrapped = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return documents.select(F.inline(F.from_json(wrapped, f"array<struct<{schema}>>")))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured log records, one JSON object per line."""
    schema = (
        "timestamp string, level string, logger string, message string, module string, function string, line int"
    )
    return spark.read.schema(schema).json(path)


def log_counts(logs: DataFrame) -> DataFrame:
    """Records by level and logger."""
    return logs.groupBy("level", "logger").agg(F.count("*").alias("n"))
