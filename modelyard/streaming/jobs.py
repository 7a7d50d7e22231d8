"""Structured Streaming jobs: counters, scoring, drift checks per closed window, alert cooldown.

Sinks are tables in the folder given by the caller. Results that change with late rows are written in update mode with
the batch number; the newest batch of a key counts, so a replayed batch does no harm.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modelyard import settings
from modelyard.functions.stats import kolmogorov_p
from modelyard.operators.history import latest_per_key
from modelyard.operators.ordered import running_totals


def start(
    stream: DataFrame, folder: str, mode: str = "append", trigger: dict | None = None, each: Callable | None = None
) -> StreamingQuery:
    """Run a stream into Parquet under `folder`/data; everything available, then stop, unless `trigger` says else."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True}))
    if each is not None:
        return writer.outputMode(mode).foreachBatch(each).start()
    return writer.outputMode(mode).format("parquet").option("path", f"{folder}/data").start()


def _numbered(folder: str) -> Callable:
    """Write every batch into a folder of its own, overwriting a replay of it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/data/part={number}")

    return write


def window_counters(stream: DataFrame, time: str, status: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Total, success and error rows per time window."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"))
        .agg(
            F.count("*").alias("total"),
            F.count(F.when(F.col(status) == "success", 1)).alias("success"),
            F.count(F.when(F.col(status) == "error", 1)).alias("error"),
        )
        .select(F.col("w.start").alias("window_start"), "total", "success", "error")
    )


def run_counters(stream: DataFrame, folder: str, time: str, status: str, **options) -> StreamingQuery:
    return start(window_counters(stream, time, status, **options), folder, "update", each=_numbered(folder))


def read_latest(spark, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key of an update-mode table."""
    table = spark.read.parquet(f"{folder}/data").drop("part")
    return latest_per_key(table, ["batch"], list(keys)).drop("batch")


def run_scoring(stream: DataFrame, model, folder: str, keep: Sequence[str]) -> StreamingQuery:
    """Score arriving rows; the model is stateless, so each row is written once."""
    return start(model.transform(stream).select(*keep, "prediction"), folder)


def window_value_counts(stream: DataFrame, time: str, columns: Sequence[str], window: str, delay: str) -> DataFrame:
    """Counts per (window, feature, value): what a distribution test needs, and all the state that is kept."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return (
        stream.withWatermark(time, delay)
        .select(time, F.inline(F.array(*entries)))
        .where("value IS NOT NULL")
        .groupBy(F.window(time, window).alias("w"), "feature", "value")
        .agg(F.count("*").alias("cur"))
        .select(F.col("w.start").alias("window_start"), "feature", "value", "cur")
    )


def check_windows(
    counts: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    min_rows: int = settings.MIN_DRIFT_ROWS,
    threshold: float = settings.DRIFT_P_VALUE,
) -> DataFrame:
    """KS test of every closed window against the reference; a window below the gate is reported as `skipped`."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    ref = (
        reference.select(F.inline(F.array(*entries)))
        .where("value IS NOT NULL")
        .groupBy("feature", "value")
        .agg(F.count("*").alias("ref"))
    )
    windows = counts.select("window_start", "feature").distinct()
    both = (
        counts.withColumn("ref", F.lit(0).cast("long"))
        .unionByName(ref.join(windows, "feature").withColumn("cur", F.lit(0).cast("long")))
        .groupBy("window_start", "feature", "value")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    keys = ["window_start", "feature"]
    totals = running_totals(both, "value", ["ref", "cur"], keys)
    sizes = totals.groupBy(*keys).agg(F.max("cum_ref").alias("n_ref"), F.max("cum_cur").alias("n_cur"))
    gap = F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_cur", "n_cur"))
    tested = totals.join(sizes, keys).groupBy(*keys, "n_ref", "n_cur").agg(F.max(gap).alias("statistic"))
    ready = F.col("n_cur") >= min_rows
    p = kolmogorov_p(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return tested.select(
        *keys,
        "n_cur",
        F.when(ready, F.col("statistic")).alias("statistic"),
        F.when(ready, p).alias("p_value"),
        F.when(~ready, "skipped").when(p < threshold, "drift").otherwise("stable").alias("status"),
    )


def run_monitoring(
    stream: DataFrame,
    reference: DataFrame,
    folder: str,
    time: str,
    columns: Sequence[str],
    window: str = "1 hour",
    delay: str = "1 hour",
    min_rows: int = settings.MIN_DRIFT_ROWS,
    after: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Check every window once it is closed; rows later than `delay` are dropped. `after` gets the results."""
    write = _numbered(folder)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                checked = check_windows(batch, reference, columns, min_rows)
                write(checked, number)
                if after is not None:
                    after(batch.sparkSession.read.parquet(f"{folder}/data/part={number}"))
        finally:
            batch.unpersist()

    return start(window_value_counts(stream, time, columns, window, delay), folder, "append", trigger, each)


def streaming_cooldown(
    stream: DataFrame, key: str, time: str, tie: str, seconds: int = settings.ALERT_COOLDOWN_SECONDS, delay: str = "1 hour"
) -> DataFrame:
    """(key, tie, time, passed) for every alert; the state of a key is its last passing time, and it expires.

    A micro-batch is taken in time order. An alert older than the last passing time of its key is suppressed.
    """
    wait = seconds * 1_000_000
    key_type, tie_type = stream.schema[key].dataType.simpleString(), stream.schema[tie].dataType.simpleString()

    def step(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", tie], kind="stable")
        last = state.get[0] if state.exists else None
        passed = []
        for at in rows["at"]:
            ok = last is None or at >= last + wait
            passed.append(ok)
            last = at if ok else last
        state.update((last,))
        due = (last + wait) // 1000 + 1
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({key: names[0], tie: rows[tie], "at": rows["at"], "passed": passed})

    rows = stream.withWatermark(time, delay).select(time, key, tie, F.unix_micros(time).alias("at"))
    out = rows.groupBy(key).applyInPandasWithState(
        step,
        f"`{key}` {key_type}, `{tie}` {tie_type}, at long, passed boolean",
        "last long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(key, tie, F.timestamp_micros("at").alias(time), "passed")


def run_centres(stream: DataFrame, model, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Move the centres of a mini-batch model with every micro-batch, and keep the model of the last one."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            model.update(batch)
            model.save(batch.sparkSession, f"{folder}/model")

    return start(stream, folder, "append", trigger, each)
