"""Alert rows, cooldown, severity and statistics."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from modelyard import settings
from modelyard.functions.values import sorted_json
from modelyard.operators.ordered import join_groups


def alert_rows(
    source: DataFrame,
    condition: Column,
    template: str,
    payload: Sequence[str],
    time: Column,
    severity: Column | None = None,
    recipients: Sequence[str] = (),
) -> DataFrame:
    """One alert per row of `source` that meets `condition`.

    The key is the template and the sorted payload; the time is kept outside, so that equal alerts have equal keys.
    """
    body = F.create_map(*[x for c in payload for x in (F.lit(c), F.col(c).cast("string"))])
    return source.where(condition).select(
        F.lit(template).alias("template"),
        time.cast("timestamp").alias("timestamp"),
        (severity if severity is not None else F.lit("medium")).alias("severity"),
        F.array(*[F.lit(r) for r in recipients]).cast("array<string>").alias("recipients"),
        F.concat_ws("_", F.lit(template), sorted_json(body)).alias("alert_key"),
        sorted_json(body).alias("data"),
    )


def severity_rank(severity: Column) -> Column:
    """critical 1 to low 4; unknown names last."""
    ranks = F.create_map(*[x for name, rank in settings.SEVERITY_RANKS.items() for x in (F.lit(name), F.lit(rank))])
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(len(settings.SEVERITY_RANKS) + 1))


def cooldown(
    alerts: DataFrame,
    key: Sequence[str],
    time: str,
    tie: str,
    seconds: int = settings.ALERT_COOLDOWN_SECONDS,
    span: int = 8,
) -> DataFrame:
    """Add `passed`: whether an alert gets through. The timer of a key restarts only when an alert passes.

    The rule is sequential per key, yet one key may hold a third of all alerts. So time is cut into pieces of `span`
    cooldowns. Per (key, piece) a first pass tells, for every moment the piece may be entered at (only the first
    cooldown of it matters), when the last alert of the piece would pass; runs of equal answers are one row. A walk
    over these few rows per key fixes the entry moment of every piece, and a second pass marks the alerts. Alerts of a
    key at the same moment are merged first, so a task holds the distinct moments of one key in `span` cooldowns.
    Alerts without a key share one timer.
    """
    key = list(key)
    wait, width = int(seconds * 1_000_000), int(seconds * 1_000_000) * span
    rows = alerts.withColumn("_ts", F.unix_micros(time)).withColumn(
        "_piece", F.floor(F.col("_ts") / F.lit(width)).cast("long")
    )
    columns = [*key, "_piece"]
    moments = rows.groupBy(*columns, "_ts").agg(F.min(tie).alias("_tie"))
    pieces = moments.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("_ts", "_tie"))).alias("_m"))
    pieces = pieces.select(*columns, F.col("_m._ts").alias("_times"), F.col("_m._tie").alias("_ties"))

    steps = _piece_steps(wait, width)(F.col("_piece"), F.col("_times"))
    chains = (
        pieces.select(*columns, steps.alias("_s"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("_piece", "_s.upto", "_s.leave"))).alias("_c"))
    )
    entries = _walk(wait)(F.col("_c.upto"), F.col("_c.leave"))
    starts = chains.select(*key, F.inline(F.arrays_zip(F.col("_c._piece").alias("_piece"), entries.alias("_entry"))))

    places = _passing(wait)(F.col("_times"), F.col("_entry"))
    passing = join_groups(pieces, starts, columns).select(
        *key, F.explode(F.transform(places, lambda i: F.struct(F.get("_times", i), F.get("_ties", i)))).alias("_p")
    )
    passing = passing.select(
        *key, F.col("_p.col1").alias("_ts"), F.col("_p.col2").alias(tie), F.lit(True).alias("passed")
    )
    marked = join_groups(rows.drop("_piece"), passing, [*key, "_ts", tie], "left")
    return marked.select(*alerts.columns, F.coalesce("passed", F.lit(False)).alias("passed"))


def _piece_steps(wait: int, width: int):
    """For a piece: up to which entry moment (`upto`) the last alert to pass is which (`leave`)."""

    def one(piece: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        follow = np.searchsorted(times, times + wait, side="left")
        last = np.where(follow < len(times), np.minimum(follow, len(times) - 1), np.arange(len(times)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        reachable = np.r_[True, times[:-1] < piece * width + wait]
        times, leave = times[reachable], times[last][reachable]
        ends = np.r_[leave[1:] != leave[:-1], True]
        return times[ends], leave[ends]

    def steps(piece: pd.Series, times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, np.asarray(t)) for p, t in zip(piece, times)], columns=["upto", "leave"])

    return pandas_udf(steps, "upto array<long>, leave array<long>")


def _walk(wait: int):
    """The moment every piece of a key is entered at, pieces in order."""

    def one(uptos, leaves) -> np.ndarray:
        entry, found = np.iinfo(np.int64).min, []
        for upto, leave in zip(uptos, leaves):
            found.append(entry)
            place = np.searchsorted(upto, entry, side="left")
            if place < len(upto):
                entry = int(leave[place]) + wait
        return np.array(found, dtype=np.int64)

    def walk(uptos: pd.Series, leaves: pd.Series) -> pd.Series:
        return pd.Series([one(u, v) for u, v in zip(uptos, leaves)], dtype=object)

    return pandas_udf(walk, "array<long>")


def _passing(wait: int):
    """Places of the moments of a piece that pass, given its entry moment."""

    def one(times: np.ndarray, entry: int) -> np.ndarray:
        found, at = [], int(np.searchsorted(times, entry, side="left"))
        while at < len(times):
            found.append(at)
            at = int(np.searchsorted(times, times[at] + wait, side="left"))
        return np.array(found, dtype=np.int32)

    def passing(times: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(t), e) for t, e in zip(times, entry)], dtype=object)

    return pandas_udf(passing, "array<int>")


def alert_totals(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total_alerts"), F.max("timestamp").alias("last_alert_time"))


def alerts_by_template(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("template").agg(F.count("*").alias("n"))


def top_recipients(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The recipients of most alerts; ties by name."""
    counts = alerts.select(F.explode("recipients").alias("recipient")).groupBy("recipient").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "recipient").limit(n)
