"""What the operators share: the meaning of a word, seeded numbers, shared scratch tables, joins of a checked size."""

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelyard.session import shared_folder

# The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A broadcast side of a few numbers per row is written, counted, and must not have more rows than this.
BROADCAST_ROWS = 100_000
# Narrow rows that are worth a task of their own.
ROWS_PER_TASK = 50_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8; bytes split on exactly `SPACES` and lower only A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_array(text: Column) -> Column:
    """The words of a text as an array, in JVM code; NULL has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, also where `body` uses it inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seeded(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**52 - 1 that depends on the seed and the parts only; the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: worked out once, and lost executors do not restart it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most about `rows` narrow rows, in as many tasks as these deserve; without a shuffle of its own."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def join_small(rows: DataFrame, small: DataFrame, on, how: str = "left", most: int | None = None) -> DataFrame:
    """Join with a table that is usually small: broadcast where its counted rows are few, else a shuffled join.

    `small` is written to the shared folder first, so that the count and the join see the same rows.
    `most` is how many narrow rows it can have, where that is known.
    """
    small = written(few(small, most) if most is not None else small, "small")
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def renamed(df: DataFrame, prefix: str = "c") -> tuple[DataFrame, list[str]]:
    """Columns by position (c0, c1, ...), so that names of the input never clash with an operator's own."""
    names = [f"{prefix}{i}" for i in range(len(df.columns))]
    return df.toDF(*names), df.columns


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return seen["n"], seen["b"] or 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of `n` word ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    key = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return key


class _Hashes(dict):
    """Numbers the distinct words it is asked for, and keeps their hashes in that order."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts in a row, and the words per text."""
    seen = _Hashes()
    numbers, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        numbers.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
        sizes[i] = len(words)
    table = np.array(seen.hashes, np.uint64)
    return (table[np.concatenate(numbers)] if len(table) else np.zeros(0, np.uint64)), sizes


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and how often each comes; by sorting, which is faster than numpy's hashing here."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(starts, append=len(values))
