"""Mixing sources to target weights by Poisson replication.

A source with weight w and n of all N documents has the repetition rate r = epochs * w * N / n. Every document gets a number of
copies by inverting the Poisson distribution of mean r at a uniform number made from the seed and its id, so a re-run gives
the same copies and no document knows of another. Copies are exploded where the document is and then brought into a global
random order by a range partitioning on a seeded key. All of it is column expressions.

Defined results: documents without a source are a source of their own (NULL). Rows with the same id draw the same number; a
NULL id draws like an empty one. A source without a weight has rate 0 when weights are given. A rate of 0 gives no copies.
An empty table gives an empty one. Other columns are carried untouched.
"""

from pyspark.sql import Column, DataFrame, functions as F

from modelyard.llm.common import join_small, partitions, renamed, seeded

UNIT = float(1 << 52)


def poisson_count(mean: Column, uniform: Column) -> Column:
    """How many k have P(X <= k) <= uniform: the quantile of a Poisson number, in logs so that no rate underflows.

    The walk ends 12 deviations above the mean, where less than 1e-30 is left.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("cdf"), F.when(uniform >= F.exp(-mean), 1).otherwise(0).alias("k"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(mean) - F.log(k.cast("double"))
        cdf = state["cdf"] + F.exp(log)
        return F.struct(log.alias("log"), cdf.alias("cdf"), (state["k"] + F.when(uniform >= cdf, 1).otherwise(0)).alias("k"))

    walked = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["k"])
    return F.when(mean > 0, walked).otherwise(0).cast("long")


def repetition_rates(
    docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0
) -> DataFrame:
    """One row per source: `source`, `documents`, `rate`.

    `weights` are the wanted shares by source; without them a source's weight is its share of documents to `power`.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    if weights is None:
        weight = F.pow(F.col("documents").cast("double"), F.lit(float(power)))
    else:
        pairs = [F.when(F.col("source") == name, float(w)) for name, w in weights.items()]
        weight = F.coalesce(*pairs, F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    # A plain total joined on nothing would be a one-row cross join; the total goes to the driver as two numbers.
    total = weighed.agg(F.sum("documents").alias("n"), F.sum("weight").alias("w")).first()
    n, w = total["n"] or 0, total["w"] or 0.0
    if not w:
        return weighed.select("source", "documents", F.lit(0.0).alias("rate"))
    return weighed.select("source", "documents", (F.lit(float(epochs)) * F.col("weight") / F.lit(w) * F.lit(float(n)) / F.col("documents")).alias("rate"))


def replicate(
    docs: DataFrame,
    source: str = "source",
    identity: str = "doc_id",
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: int = 7,
    added: str | None = "mix",
) -> DataFrame:
    """Copies in global random order: the columns of `docs` and a struct `added` (rate, copies, copy, shuffle_key).

    Without `added` the columns are those of `docs` alone, also where one of them has the name of the struct.
    """
    spark = docs.sparkSession
    rates = repetition_rates(docs, source, weights, power, epochs).select(F.col("source").alias("_mix_source"), "rate")
    rows, names = renamed(docs)
    own, kind = F.col(f"c{docs.columns.index(identity)}"), F.col(f"c{docs.columns.index(source)}")
    rows = join_small(rows, rates, kind.eqNullSafe(F.col("_mix_source")), "inner")
    copies = poisson_count(F.col("rate"), seeded(seed, own) / F.lit(UNIT))
    rows = rows.withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("shuffle_key", seeded(seed + 1, own, F.col("copy")))
    # The key is uniform, so equal ranges of it are equal shares of the rows, whatever the sources are.
    rows = rows.repartitionByRange(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key")
    drawn = [F.struct("rate", "copies", "copy", "shuffle_key").alias(added)] if added else []
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *drawn)
