"""Data drift between a reference table and a current table.

All columns are compared in one melted pass: counts per (feature, side, value) are merged before any shuffle, and the
empirical distributions come from `ordered.running_totals`. Our own choices, where no behaviour is given: the
Jensen-Shannon divergence uses 30 equal bins over the pooled range and base 2; the chi-square test is the test of
homogeneity of side by category, without continuity correction.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard import settings
from modelyard.functions.stats import chi_square_p, kolmogorov_p
from modelyard.operators.ordered import running_totals
from modelyard.operators.profile import column_roles


def sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables under each other with `is_current`."""
    pick = [F.col(f"`{c}`") for c in columns]
    return reference.select(*pick, F.lit(False).alias("is_current")).unionByName(
        current.select(*pick, F.lit(True).alias("is_current"))
    )


def _melt(both: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns]
    melted = both.select("is_current", F.inline(F.array(*entries)))
    present = F.col("value").isNotNull()
    return melted.where(present & ~F.isnan("value") if kind == "double" else present)


def _counts(melted: DataFrame, *keys) -> DataFrame:
    return melted.groupBy("feature", *keys).agg(
        F.count(F.when(~F.col("is_current"), 1)).alias("ref"), F.count(F.when(F.col("is_current"), 1)).alias("cur")
    )


def ks_test(
    both: DataFrame, columns: Sequence[str], threshold: float = settings.DRIFT_P_VALUE, ranges: int | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per numeric column: exact statistic, large-sample p-value.

    A column without values on one side has neither, and no drift.
    """
    melted = _melt(both, columns, "double")
    totals = running_totals(
        _counts(melted, "value"), "value", ["ref", "cur"], ["feature"], ranges=ranges, source=melted
    )
    sums = totals.groupBy("feature").agg(F.max("cum_ref").alias("n_ref"), F.max("cum_cur").alias("n_cur"))
    gap = F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_cur", "n_cur"))
    tested = totals.join(sums, "feature").groupBy("feature", "n_ref", "n_cur").agg(F.max(gap).alias("statistic"))
    tested = tested.withColumn("p_value", kolmogorov_p(F.col("statistic"), F.col("n_ref"), F.col("n_cur")))
    return tested.withColumn("is_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def _binned(both: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Counts per (feature, equal-width bin) and side, over the pooled range."""
    bounds = both.agg(
        *[f(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))).alias(f"{p}{i}")
          for i, c in enumerate(columns) for p, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    entries = []
    for i, c in enumerate(columns):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        value = F.col(f"`{c}`").cast("double")
        bin_ = bin_number(value, lo, hi, bins)
        entries.append(F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(value), bin_).alias("bin")))
    melted = both.select("is_current", F.inline(F.array(*entries))).where("bin IS NOT NULL")
    return _counts(melted, "bin")


def bin_number(value: Column, lo: float | None, hi: float | None, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin."""
    if lo is None or hi is None or lo == hi:
        return F.when(value.isNotNull(), F.lit(0))
    place = F.floor((value - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int")
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1))


def _with_shares(counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    return counts.join(sums, "feature").withColumns(
        {"p": F.try_divide("ref", "n_ref"), "q": F.try_divide("cur", "n_cur")}
    )


def js_divergence(
    both: DataFrame, columns: Sequence[str], bins: int = settings.JS_BINS, threshold: float = settings.JS_THRESHOLD
) -> DataFrame:
    """Jensen-Shannon divergence (base 2) per numeric column."""
    middle = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)

    shares = _with_shares(_binned(both, columns, bins))
    out = shares.groupBy("feature").agg((F.sum(part("p") + part("q")) / 2).alias("value"))
    return out.withColumn("is_drift", F.coalesce(F.col("value") > threshold, F.lit(False)))


def category_counts(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _counts(_melt(both, columns, "string"), F.col("value").alias("category"))


def chi_square(both: DataFrame, columns: Sequence[str], threshold: float = settings.DRIFT_P_VALUE) -> DataFrame:
    """Chi-square test of homogeneity per categorical column."""
    shares = _with_shares(category_counts(both, columns))
    total = F.col("n_ref") + F.col("n_cur")
    row = F.col("ref") + F.col("cur")
    expected_ref, expected_cur = row * F.col("n_ref") / total, row * F.col("n_cur") / total
    term = F.when(expected_ref > 0, F.pow(F.col("ref") - expected_ref, 2) / expected_ref).otherwise(0.0) + F.when(
        expected_cur > 0, F.pow(F.col("cur") - expected_cur, 2) / expected_cur
    ).otherwise(0.0)
    out = shares.groupBy("feature").agg(F.sum(term).alias("statistic"), (F.count("*") - 1).alias("dof"))
    out = out.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("dof").cast("double")))
    return out.withColumn("is_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def category_shift(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute change of category shares: over categories of both sides, and over all (`importance_full`)."""
    change = F.abs(F.col("p") - F.col("q"))
    return (
        _with_shares(category_counts(both, columns))
        .groupBy("feature")
        .agg(
            F.avg(F.when((F.col("ref") > 0) & (F.col("cur") > 0), change)).alias("importance"),
            F.avg(change).alias("importance_full"),
        )
    )


def side_information(both: DataFrame, columns: Sequence[str], bins: int = settings.JS_BINS) -> DataFrame:
    """Mutual information (nats) of the bin of a numeric column and the side.

    Rows have no position in a distributed table, so the two samples are not paired; how much a value tells about
    its side serves as the importance instead.
    """
    shares = _with_shares(_binned(both, columns, bins))
    total = F.col("n_ref") + F.col("n_cur")
    row = F.col("ref") + F.col("cur")

    def part(count: str, side: str) -> Column:
        joint = F.col(count) / total
        return F.when(F.col(count) > 0, joint * F.log(F.col(count) * total / (row * F.col(side)))).otherwise(0.0)

    out = shares.groupBy("feature").agg(F.sum(part("ref", "n_ref") + part("cur", "n_cur")).alias("importance"))
    return out.withColumn("importance_full", F.col("importance"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    p_threshold: float = settings.DRIFT_P_VALUE,
    js_threshold: float = settings.JS_THRESHOLD,
) -> DataFrame:
    """One row per (feature, test): statistic, p-value, verdict and importance; `drift_detected` is any test of it."""
    roles = column_roles(reference)
    numeric = roles["numeric"] if numeric is None else list(numeric)
    categorical = roles["categorical"] if categorical is None else list(categorical)
    both = sides(reference, current, [*numeric, *categorical])
    parts = []
    null = F.lit(None).cast("double")
    if numeric:
        ks = ks_test(both, numeric, p_threshold)
        js = js_divergence(both, numeric, threshold=js_threshold)
        weight = side_information(both, numeric).select("feature", "importance")
        tests = ks.select("feature", F.lit("ks_test").alias("test"), "statistic", "p_value", "is_drift").unionByName(
            js.select(
                "feature", F.lit("js_divergence").alias("test"), F.col("value").alias("statistic"), null.alias("p_value"), "is_drift"
            )
        )
        parts.append(tests.join(weight, "feature", "left"))
    if categorical:
        chi = chi_square(both, categorical, p_threshold)
        weight = category_shift(both, categorical).select("feature", "importance")
        parts.append(
            chi.select("feature", F.lit("chi_square").alias("test"), "statistic", "p_value", "is_drift").join(
                weight, "feature", "left"
            )
        )
    if not parts:
        raise ValueError("no column to compare")
    tests = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    verdict = tests.groupBy("feature").agg(F.bool_or("is_drift").alias("drift_detected"))
    return tests.join(verdict, "feature").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def overall_drift(features: DataFrame) -> DataFrame:
    """The verdict over all features from (feature, drift_detected) rows, duplicates allowed."""
    per_feature = features.groupBy("feature").agg(F.bool_or("drift_detected").alias("drift_detected"))
    ratio = F.coalesce(F.avg(F.col("drift_detected").cast("double")), F.lit(0.0))
    row = per_feature.agg(
        ratio.alias("drift_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("drifted_features"),
    )
    return row.select(
        (F.col("drift_ratio") > 0.3).alias("is_significant"),
        "drift_ratio",
        "drifted_features",
        F.when(F.col("drift_ratio") > 0.5, "high").when(F.col("drift_ratio") > 0.3, "medium").otherwise("low").alias("severity"),
    )


def drift_rows(report: DataFrame, model_id: str, detected_at: Column) -> DataFrame:
    """Report rows in the shape of the `data_drift` table: one per feature, scored by the KS statistic or 0."""
    score = F.max(F.when(F.col("test") == "ks_test", F.col("statistic")))
    kind = F.when(F.bool_or(F.col("test") == "chi_square"), "categorical").otherwise("numeric")
    return (
        report.groupBy("feature", "drift_detected", "importance")
        .agg(F.coalesce(score, F.lit(0.0)).alias("drift_score"), kind.alias("drift_type"))
        .select(
            F.lit(model_id).alias("model_id"),
            detected_at.cast("timestamp").alias("detection_time"),
            F.col("feature").alias("feature_name"),
            "drift_score",
            "drift_detected",
            "drift_type",
            F.lit(None).cast("string").alias("severity"),
            F.to_json(F.struct("importance")).alias("drift_info"),
        )
    )


def enough_rows(df: DataFrame, minimum: int = settings.MIN_DRIFT_ROWS) -> DataFrame:
    """Row count of a window and whether a drift check may run on it."""
    return df.agg(F.count("*").alias("rows"), (F.count("*") >= minimum).alias("ready"))
