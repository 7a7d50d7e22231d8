"""The registered queries of the operators, and the SQL that means the same where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modelyard.llm import (
    exact_dedup, licenses, lm_scoring, merkle, mixing, ngram_join, oracles, packing, quality, token_output, toxicity, url_filter, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_tokens(text) -> Column:
    """Words and an end mark: the length that the packing query works with."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


@query(oracles.quality_sql())
def op2_quality_rules(spark, sf_dir):
    """Base counts and risk-controlled verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(oracles.packing_sql())
def op4_length_buckets(spark, sf_dir):
    """Bucket, boundary and batch of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), n_tokens(F.col("text")))


@query(oracles.DEDUP_SQL)
def op6_grace_dedup(spark, sf_dir):
    """Which row stays for every document."""
    return exact_dedup.groups_of(table(spark, sf_dir, "documents"))


@query(oracles.mixing_sql())
def op9_poisson_mixing(spark, sf_dir):
    """Every copy of every document, in global random order."""
    mixed = mixing.replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "text", F.round("mix.rate", 9).alias("rate"), "mix.copies", "mix.copy", "mix.shuffle_key")


@query()
def op8_deleted_interpolation(spark, sf_dir):
    """Base and mixture log-probability of every document."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query(oracles.JOIN_SQL)
def op10_ngram_jaccard(spark, sf_dir):
    """The group of every document under five-word shingles and a similarity of 0.75."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query()
def op1_bit_packed_tokens(spark, sf_dir):
    """Place, length and checksum of every document, read back from the token file."""
    import public_tokenizers

    return token_output.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


@query()
def op3_counterfactual_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(oracles.licenses_sql())
def op5_license_rules(spark, sf_dir):
    """Licence sentences and licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


# Fixed values of the contract.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query()
def op7_segmented_urls(spark, sf_dir):
    """Rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query(oracles.WARC_SQL)
def op11_warc_revisits(spark, sf_dir):
    """Record of every page, read back from deduplicated archives."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query()
def op12_jacobi_whitening(spark, sf_dir):
    """Whitened components of every usable vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(oracles.merkle_sql())
def op13_octopus_manifest(spark, sf_dir):
    """Leaf, roots and proof of every document, and whether a partly tampered table still proves its root."""
    return merkle.audit(table(spark, sf_dir, "documents"))
