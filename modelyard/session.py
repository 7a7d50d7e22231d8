"""Session set-up and lineage cutting."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators need. They are set on every session that is used, whatever it had before.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets "newest N rows per key" keep only N rows per key on the map side, for windows above the default of 1000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}


def build_session(app_name: str = "modelyard", master: str | None = None, **options) -> SparkSession:
    """A session with adaptive execution on; `options` are extra Spark settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **RUNTIME_SETTINGS,
    }
    for key, value in {**defaults, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings on a session somebody else made."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one is made only for local masters."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="modelyard-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so that lost executors do not restart an iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def balanced(df: DataFrame) -> DataFrame:
    """Rows in even partitions of a sensible size, whatever the input files looked like.

    Meant once before work that reads the rows many times, such as a fit. Adaptive execution picks the partition count
    from the real size, and splits or merges as needed.
    """
    return df.hint("rebalance")
