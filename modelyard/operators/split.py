"""Hold-out splits, folds, class weights."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard import settings
from modelyard.operators.ordered import join_groups, row_rank


def draw(key: Sequence[str], seed: int = settings.RANDOM_STATE) -> Column:
    """A number in [0, 1) that depends on the row key and the seed only, so a re-run task draws the same."""
    cells = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    return F.pmod(cells, F.lit(1 << 53)) / F.lit(float(1 << 53))


def train_test_split(
    df: DataFrame, key: Sequence[str], test_size: float = settings.TEST_SIZE, seed: int = settings.RANDOM_STATE
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: no shuffle, no row order."""
    chosen = draw(key, seed) < test_size
    return df.where(~chosen), df.where(chosen)


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = settings.TEST_SIZE,
    seed: int = settings.RANDOM_STATE,
) -> tuple[DataFrame, DataFrame]:
    """Exactly round(n * test_size) rows of every class go to the test side, drawn by a hash of the unique key.

    The rank inside a class comes from `row_rank`, so a class that holds most rows is not one task. Rows without a label
    are a class of their own.
    """
    drawn = df.withColumn("_draw", draw([key], seed))
    ranked = row_rank(drawn, "_draw", [label])
    sizes = df.groupBy(label).agg(F.round(F.count("*") * test_size).cast("long").alias("_take"))
    tagged = join_groups(ranked, sizes, [label]).withColumn("_test", F.col("row_rank") <= F.col("_take"))
    kept = tagged.select(*df.columns, "_test")
    return kept.where(~F.col("_test")).drop("_test"), kept.where("_test").drop("_test")


def hash_folds(df: DataFrame, key: Sequence[str], k: int = settings.CV_FOLDS, seed: int = settings.RANDOM_STATE) -> DataFrame:
    """Add `fold`, 0..k-1, by a hash of the key: fold sizes are even up to chance, and nothing is shuffled."""
    return df.withColumn("fold", F.floor(draw(key, seed) * k).cast("int"))


def block_folds(df: DataFrame, key: str, k: int = settings.CV_FOLDS) -> DataFrame:
    """Add `fold`: contiguous blocks by a unique key; the first n mod k folds hold one row more."""
    ranked = row_rank(df, key)
    n = ranked.agg(F.count("*")).scalar()
    size, extra = F.floor(n / k), n % k
    at = F.col("row_rank") - 1
    head = extra * (size + 1)
    fold = F.when(at < head, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - head) / size))
    return ranked.withColumn("fold", fold.cast("int")).drop("row_rank")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = settings.CV_FOLDS) -> DataFrame:
    """Add `fold`: contiguous blocks by key inside every class, sized so that classes and folds both stay even.

    With the classes laid end to end, fold i gets as many rows of a class as the class interval has positions = i mod k.
    Rows without a label are a class of their own, the first.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()
    start, limits = 0, []
    for row in counts:
        stop = start + row["n"]
        sizes = [len(range(start + (i - start) % k, stop, k)) for i in range(k)]
        ends = [sum(sizes[: i + 1]) for i in range(k)]
        limits.append((row[label], ends))
        start = stop
    table = df.sparkSession.createDataFrame(
        limits, f"`{label}` {df.schema[label].dataType.simpleString()}, _ends array<long>"
    )
    ranked = join_groups(row_rank(df, key, [label]), table, [label])
    fold = F.size(F.filter("_ends", lambda end: end < F.col("row_rank")))
    return ranked.select(*df.columns, fold.cast("int").alias("fold"))


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the weight n / (classes * rows of the class); rows without a label are a class of their own."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg((F.sum("_n") / F.count("*")).alias("share")).scalar()
    table = counts.select(label, (whole / F.col("_n")).alias(weight))
    return join_groups(df, table, [label]).select(*df.columns, weight)
