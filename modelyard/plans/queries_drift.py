"""Drift queries: the first and second half of `events` by time, and `lineitem` before and after a shipping date."""

from pyspark.sql import DataFrame, functions as F

from modelyard.operators import drift as D
from modelyard.operators import history as H
from modelyard.operators import performance as P
from modelyard.operators import reports as V
from modelyard.plans.catalog import Tables, query, rounded

CUT = "2024-01-16 00:00:00"
SHIP_CUT = "1997-01-01 00:00:00"


def event_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUT).cast("timestamp")
    return t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut)


def line_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(SHIP_CUT).cast("timestamp")
    return t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_FLAGS = ["l_returnflag", "l_linestatus"]

LINE_NUMBERS_SQL = f"""
WITH both_sides AS (SELECT *, l_shipdate >= TIMESTAMP '{SHIP_CUT}' AS is_current FROM lineitem),
melted AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS value, is_current FROM both_sides" for c in LINE_COLUMNS)}),
sizes AS (
  SELECT feature, count(*) FILTER (NOT is_current) AS n_ref, count(*) FILTER (is_current) AS n_cur, min(value) AS lo,
         max(value) AS hi
  FROM melted GROUP BY 1)
"""

KS_SQL = LINE_NUMBERS_SQL + """, counts AS (
  SELECT feature, value, count(*) FILTER (NOT is_current) AS r, count(*) FILTER (is_current) AS c FROM melted GROUP BY ALL),
cdf AS (
  SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (
  SELECT feature, n_ref, n_cur, max(abs(cr::DOUBLE / n_ref - cc::DOUBLE / n_cur)) AS statistic
  FROM cdf JOIN sizes USING (feature) GROUP BY ALL),
scaled AS (SELECT *, statistic * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS x FROM ks),
tested AS (
  SELECT feature, n_ref, n_cur, statistic,
         CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * (
           SELECT sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * x * x)) FROM range(1, 101) r(j)))) END AS p_value
  FROM scaled)
"""


@query(
    "ks_drift",
    KS_SQL
    + """SELECT feature, n_ref, n_cur, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS is_drift
FROM tested""",
)
def ks_drift(t):
    return rounded(D.ks_test(D.sides(*line_sides(t), LINE_COLUMNS), LINE_COLUMNS))


BINS_SQL = LINE_NUMBERS_SQL + """, binned AS (
  SELECT m.feature, n_ref, n_cur, least(29, greatest(0, floor((value - lo) / (hi - lo) * 30)::INT)) AS bin,
         count(*) FILTER (NOT is_current)::DOUBLE AS r, count(*) FILTER (is_current)::DOUBLE AS c
  FROM melted m JOIN sizes s USING (feature) GROUP BY ALL),
shares AS (SELECT *, r / n_ref AS p, c / n_cur AS q, (r / n_ref + c / n_cur) / 2 AS m FROM binned)
"""


@query(
    "js_drift",
    BINS_SQL
    + """SELECT feature, round(value, 6) AS value, value > 0.1 AS is_drift FROM (
  SELECT feature, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2 AS value
  FROM shares GROUP BY 1)""",
)
def js_drift(t):
    return rounded(D.js_divergence(D.sides(*line_sides(t), LINE_COLUMNS), LINE_COLUMNS))


@query(
    "drift_information",
    BINS_SQL
    + """SELECT feature, round(v, 6) AS importance, round(v, 6) AS importance_full FROM (
  SELECT feature, sum((CASE WHEN r > 0 THEN r / (n_ref + n_cur) * ln(r * (n_ref + n_cur) / ((r + c) * n_ref)) ELSE 0 END)
                    + (CASE WHEN c > 0 THEN c / (n_ref + n_cur) * ln(c * (n_ref + n_cur) / ((r + c) * n_cur)) ELSE 0 END)) AS v
  FROM shares GROUP BY 1)""",
)
def drift_information(t):
    return rounded(D.side_information(D.sides(*line_sides(t), LINE_COLUMNS), LINE_COLUMNS))


EVENT_SHARES_SQL = f"""
WITH sides AS (SELECT *, ts >= TIMESTAMP '{CUT}' AS is_current FROM events),
counts AS (
  SELECT event_type, count(*) FILTER (NOT is_current)::DOUBLE AS r, count(*) FILTER (is_current)::DOUBLE AS c
  FROM sides GROUP BY 1),
totals AS (SELECT sum(r) AS n_ref, sum(c) AS n_cur, count(*) AS k FROM counts)
"""


@query(
    "chi2_drift",
    EVENT_SHARES_SQL
    + """, s AS (
  SELECT max(k) - 1 AS dof, sum(pow(r - (r + c) * n_ref / (n_ref + n_cur), 2) / ((r + c) * n_ref / (n_ref + n_cur))
             + pow(c - (r + c) * n_cur / (n_ref + n_cur), 2) / ((r + c) * n_cur / (n_ref + n_cur))) AS x
  FROM counts, totals)
SELECT 'event_type' AS feature, round(x, 6) AS statistic, dof::BIGINT AS dof, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value,
       exp(-x / 2) * (1 + x / 2) < 0.05 AS is_drift
FROM s WHERE dof = 4""",
)
def chi2_drift(t):
    """With five event types there are four degrees of freedom, where the p-value has a closed form for the SQL side."""
    return rounded(D.chi_square(D.sides(*event_sides(t), ["event_type"]), ["event_type"]))


@query(
    "category_shift",
    EVENT_SHARES_SQL
    + """SELECT 'event_type' AS feature, round(avg(abs(r / n_ref - c / n_cur)) FILTER (r > 0 AND c > 0), 6) AS importance,
       round(avg(abs(r / n_ref - c / n_cur)), 6) AS importance_full
FROM counts, totals""",
)
def category_shift(t):
    return rounded(D.category_shift(D.sides(*event_sides(t), ["event_type"]), ["event_type"]))


def line_report(t: Tables) -> DataFrame:
    return D.drift_report(*line_sides(t), numeric=LINE_COLUMNS, categorical=LINE_FLAGS)


TESTS_SQL = KS_SQL + """, binned AS (
  SELECT m.feature, n_ref, n_cur, least(29, greatest(0, floor((value - lo) / (hi - lo) * 30)::INT)) AS bin,
         count(*) FILTER (NOT is_current)::DOUBLE AS r, count(*) FILTER (is_current)::DOUBLE AS c
  FROM melted m JOIN sizes s USING (feature) GROUP BY ALL),
shares AS (SELECT *, r / n_ref AS p, c / n_cur AS q, (r / n_ref + c / n_cur) / 2 AS m FROM binned),
js AS (
  SELECT feature, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2 AS js,
         sum((CASE WHEN r > 0 THEN r / (n_ref + n_cur) * ln(r * (n_ref + n_cur) / ((r + c) * n_ref)) ELSE 0 END)
           + (CASE WHEN c > 0 THEN c / (n_ref + n_cur) * ln(c * (n_ref + n_cur) / ((r + c) * n_cur)) ELSE 0 END)) AS importance
  FROM shares GROUP BY 1),
tests AS (
  SELECT feature, 'ks_test' AS test, statistic, p_value, p_value < 0.05 AS is_drift FROM tested
  UNION ALL SELECT feature, 'js_divergence', js, NULL, js > 0.1 FROM js)
SELECT feature, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, is_drift, round(importance, 6) AS importance,
       bool_or(is_drift) OVER (PARTITION BY feature) AS drift_detected FROM tests JOIN js USING (feature)"""


@query("drift_report_numeric", TESTS_SQL)
def drift_report_numeric(t):
    return rounded(D.drift_report(*line_sides(t), numeric=LINE_COLUMNS, categorical=[]))


@query("drift_report")
def drift_report(t):
    return line_report(t)


OVERALL_SQL = KS_SQL + """, divergence AS (
  SELECT m.feature, n_ref, n_cur, least(29, greatest(0, floor((value - lo) / (hi - lo) * 30)::INT)) AS bin,
         count(*) FILTER (NOT is_current)::DOUBLE AS r, count(*) FILTER (is_current)::DOUBLE AS c
  FROM melted m JOIN sizes s USING (feature) GROUP BY ALL),
js AS (
  SELECT feature, sum((CASE WHEN r > 0 THEN r / n_ref * log2(r / n_ref / ((r / n_ref + c / n_cur) / 2)) ELSE 0 END)
                    + (CASE WHEN c > 0 THEN c / n_cur * log2(c / n_cur / ((r / n_ref + c / n_cur) / 2)) ELSE 0 END)) / 2 > 0.1 AS d
  FROM divergence GROUP BY 1),
verdicts AS (SELECT feature, p_value < 0.05 OR d AS drifted FROM tested JOIN js USING (feature)),
overall AS (SELECT avg(drifted::INT) AS ratio, coalesce(list_sort(list(feature) FILTER (drifted)), []) AS features FROM verdicts)
SELECT ratio > 0.3 AS is_significant, round(ratio, 6) AS drift_ratio, array_to_string(features, ',') AS drifted_features,
       CASE WHEN ratio > 0.5 THEN 'high' WHEN ratio > 0.3 THEN 'medium' ELSE 'low' END AS severity
FROM overall"""


@query("drift_overall", OVERALL_SQL)
def drift_overall(t):
    report = D.drift_report(*line_sides(t), numeric=LINE_COLUMNS, categorical=[])
    overall = D.overall_drift(report.select("feature", "drift_detected"))
    return rounded(overall.withColumn("drifted_features", F.concat_ws(",", "drifted_features")))


@query("drift_rows")
def drift_rows(t):
    return D.drift_rows(line_report(t), "shipping", F.lit("1999-01-01").cast("timestamp"))


@query("feature_status")
def feature_status(t):
    return V.feature_status(line_report(t))


@query(
    "sample_gate",
    "SELECT event_type, count(*) AS rows, count(*) >= 1000 AS ready FROM events GROUP BY 1",
)
def sample_gate(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("rows"), (F.count("*") >= 1000).alias("ready"))


# A model per event type; its daily mean value plays the metric.
SERIES_SQL = """
WITH history AS (
  SELECT event_type AS model_id, date_trunc('day', ts)::TIMESTAMP AS timestamp, avg(value) / 100 AS value FROM events GROUP BY ALL),
steps AS (
  SELECT *, value - lag(value) OVER (PARTITION BY model_id ORDER BY timestamp) AS change FROM history),
trends AS (
  SELECT model_id, avg(change) AS mean_change, coalesce(stddev_pop(change), 0) AS volatility FROM steps GROUP BY 1)
"""


def daily_series(t: Tables) -> DataFrame:
    day = F.date_trunc("day", F.col("ts")).alias("timestamp")
    return t.events.groupBy(F.col("event_type").alias("model_id"), day).agg((F.avg("value") / 100).alias("value"))


@query("metric_differences", SERIES_SQL + "SELECT model_id, timestamp, round(value, 6) AS value, round(change, 6) AS change FROM steps")
def metric_differences(t):
    return rounded(P.differences(daily_series(t)))


@query(
    "performance_trend",
    SERIES_SQL
    + """SELECT model_id, CASE WHEN mean_change IS NULL THEN 'unknown' WHEN mean_change > 0 THEN 'improving' ELSE 'degrading' END AS direction,
       round(volatility, 6) AS volatility, CASE WHEN volatility < 0.1 THEN 'stable' ELSE 'unstable' END AS stability
FROM trends""",
)
def performance_trend(t):
    return rounded(P.trend(daily_series(t)))


@query(
    "performance_statistics",
    SERIES_SQL
    + """SELECT model_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max FROM history GROUP BY 1""",
)
def performance_statistics(t):
    return rounded(P.statistics(daily_series(t)))


@query(
    "degradation_check",
    SERIES_SQL
    + """, latest AS (SELECT model_id, arg_max(value, timestamp) AS current, max(timestamp) AS at FROM history GROUP BY 1),
past AS (SELECT h.* FROM history h JOIN latest l ON h.model_id = l.model_id AND h.timestamp < l.at AND h.timestamp >= l.at - INTERVAL 14 DAYS),
base AS (SELECT model_id, avg(value) AS baseline FROM past GROUP BY 1)
SELECT model_id, round(current, 6) AS current, round(baseline, 6) AS baseline, round(baseline * 0.95, 6) AS threshold,
       CASE WHEN baseline IS NULL THEN 'no_history' WHEN current < baseline * 0.95 THEN 'degraded' ELSE 'stable' END AS status
FROM latest LEFT JOIN base USING (model_id)""",
)
def degradation_check(t):
    history = daily_series(t)
    latest = H.latest_per_key(history, ["timestamp"], ["model_id"])
    at = latest.select("model_id", F.col("timestamp").alias("at"))
    past = history.join(at, "model_id").where(
        (F.col("timestamp") < F.col("at")) & (F.col("timestamp") >= F.col("at") - F.expr("INTERVAL 14 DAYS"))
    )
    checked = P.check_performance(latest.select("model_id", "value"), past.select("model_id", "timestamp", "value"))
    return rounded(checked.select("model_id", "current", "baseline", "threshold", "status"))


@query(
    "metric_history_window",
    SERIES_SQL
    + """SELECT model_id, timestamp, round(value, 6) AS value FROM history
WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS""",
)
def metric_history_window(t):
    return rounded(P.recent(daily_series(t), F.lit("2024-01-31").cast("timestamp"), 7))


@query(
    "metric_date_range",
    SERIES_SQL
    + """SELECT model_id, timestamp, round(value, 6) AS value FROM history
WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""",
)
def metric_date_range(t):
    start, end = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")
    return rounded(P.between(daily_series(t), start, end))


# Two metrics per day and event type, as a map.
MAPS_SQL = """
WITH long AS (
  SELECT event_type AS model_id, date_trunc('day', ts)::TIMESTAMP AS timestamp, 'accuracy' AS metric, avg(value) / 100 AS value FROM events GROUP BY ALL
  UNION ALL
  SELECT event_type, date_trunc('day', ts)::TIMESTAMP, 'recall', min(value) FROM events GROUP BY ALL)
"""


def daily_maps(t: Tables) -> DataFrame:
    day = F.date_trunc("day", F.col("ts")).alias("timestamp")
    both = F.create_map(F.lit("accuracy"), F.avg("value") / 100, F.lit("recall"), F.min("value"))
    return t.events.groupBy(F.col("event_type").alias("model_id"), day).agg(both.alias("metrics"))


@query(
    "metric_pick",
    SERIES_SQL + "SELECT model_id, timestamp, round(value, 6) AS value FROM history",
)
def metric_pick(t):
    return rounded(P.metric_series(daily_maps(t)))


@query(
    "metric_summary",
    MAPS_SQL
    + """SELECT model_id, metric, round(arg_max(value, timestamp), 6) AS current, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(regr_slope(value, epoch_us(timestamp) / 86400e6), 6) AS trend
FROM long GROUP BY ALL""",
)
def metric_summary(t):
    return rounded(P.metric_summary(daily_maps(t)))


@query(
    "metric_points",
    MAPS_SQL + "SELECT model_id, timestamp, metric, upper(metric[1]) || metric[2:] AS label, round(value, 6) AS value FROM long",
)
def metric_points(t):
    return rounded(V.metric_points(daily_maps(t)))


# A drift table: the daily mean per event type against the mean of the whole type.
DRIFT_TABLE_SQL = """
WITH daily AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS v FROM events GROUP BY ALL),
whole AS (SELECT event_type, avg(value) AS v FROM events GROUP BY ALL),
drift AS (
  SELECT d.event_type AS feature_name, d.day AS detection_time, abs(d.v - w.v) / w.v AS drift_score,
         abs(d.v - w.v) / w.v > 0.1 AS drift_detected
  FROM daily d JOIN whole w USING (event_type))
"""


def drift_table(t: Tables) -> DataFrame:
    daily = t.events.groupBy(
        F.col("event_type").alias("feature_name"), F.date_trunc("day", F.col("ts")).alias("detection_time")
    ).agg(F.avg("value").alias("v"))
    whole = t.events.groupBy(F.col("event_type").alias("feature_name")).agg(F.avg("value").alias("w"))
    score = F.abs(F.col("v") - F.col("w")) / F.col("w")
    return daily.join(whole, "feature_name").select(
        "feature_name",
        "detection_time",
        score.alias("drift_score"),
        (score > 0.1).alias("drift_detected"),
        F.lit(1).alias("id"),
    )


@query(
    "drift_summary",
    DRIFT_TABLE_SQL
    + """SELECT count(*) AS total_checks, count(*) FILTER (drift_detected) AS drift_detected_count,
       count(DISTINCT feature_name) FILTER (drift_detected) AS features_affected, max(detection_time) AS last_detection FROM drift""",
)
def drift_summary(t):
    return H.drift_summary(drift_table(t))


HEAT_DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@query(
    "drift_heatmap",
    DRIFT_TABLE_SQL
    + "SELECT feature_name, "
    + ", ".join(
        f"round(coalesce(max(drift_score) FILTER (detection_time = TIMESTAMP '{d}'), 0), 6) AS \"{d}\"" for d in HEAT_DAYS
    )
    + " FROM drift GROUP BY 1",
)
def drift_heatmap(t):
    table = drift_table(t).withColumn("detection_time", F.date_format("detection_time", "yyyy-MM-dd"))
    return rounded(V.drift_heatmap(table, HEAT_DAYS))


# One monitoring check per day: which types drifted, and whether the overall mean fell.
CHECKS_SQL = DRIFT_TABLE_SQL + """, overall AS (SELECT avg(value) AS v FROM events),
days AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS v FROM events GROUP BY 1),
checks AS (
  SELECT d.detection_time AS timestamp, avg(d.drift_detected::INT) AS ratio,
         list_sort(list(feature_name) FILTER (drift_detected)) AS features, min(days.v) < 0.95 * min(o.v) AS degraded
  FROM drift d JOIN days ON days.day = d.detection_time, overall o GROUP BY 1)
"""


def daily_checks(t: Tables) -> DataFrame:
    drift = drift_table(t)
    baseline = t.events.agg(F.avg("value") * 0.95).scalar()
    days = t.events.groupBy(F.date_trunc("day", F.col("ts")).alias("timestamp")).agg(F.avg("value").alias("v"))
    found = drift.groupBy(F.col("detection_time").alias("timestamp")).agg(
        (F.avg(F.col("drift_detected").cast("double")) > 0.3).alias("is_significant"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature_name")))).alias("drifted_features"),
    )
    return days.withColumn("baseline", baseline).join(found, "timestamp").select(
        "timestamp",
        "is_significant",
        "drifted_features",
        F.when(F.col("v") < F.col("baseline"), "degraded").otherwise("stable").alias("status"),
    )


@query(
    "monitoring_summary",
    CHECKS_SQL
    + """SELECT count(*) AS total_checks, round(avg((ratio > 0.3)::INT), 6) AS drift_frequency,
       round(avg(degraded::INT), 6) AS performance_degradation_frequency, max(timestamp) AS last_check FROM checks""",
)
def monitoring_summary(t):
    return rounded(H.monitoring_summary(daily_checks(t)))


@query(
    "most_drifted",
    CHECKS_SQL
    + """, f AS (SELECT unnest(features) AS feature FROM checks)
SELECT feature, round(count(*) / (SELECT count(*) FROM checks)::DOUBLE, 6) AS drift_frequency FROM f
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5""",
)
def most_drifted(t):
    return rounded(H.most_drifted(daily_checks(t)))


HEALTH_SQL = DRIFT_TABLE_SQL + """, whole_drift AS (SELECT feature_name AS model_id, avg(drift_detected::INT) AS ratio FROM drift GROUP BY 1),
perf AS (SELECT feature_name AS model_id, arg_max(drift_score, detection_time) > 0.2 AS degraded FROM drift GROUP BY 1)
"""


@query(
    "model_health",
    HEALTH_SQL
    + """SELECT model_id, CASE WHEN degraded OR ratio > 0.5 THEN 'critical' WHEN ratio > 0.3 THEN 'warning' ELSE 'healthy' END AS health
FROM whole_drift JOIN perf USING (model_id)""",
)
def model_health(t):
    table = drift_table(t).withColumnRenamed("feature_name", "model_id")
    ratio = F.avg(F.col("drift_detected").cast("double"))
    drift = table.groupBy("model_id").agg(
        (ratio > 0.3).alias("is_significant"),
        F.when(ratio > 0.5, "high").when(ratio > 0.3, "medium").otherwise("low").alias("severity"),
    )
    last = F.max_by("drift_score", "detection_time")
    performance = table.groupBy("model_id").agg(F.when(last > 0.2, "degraded").otherwise("stable").alias("status"))
    return P.health(performance, drift)


@query(
    "health_list",
    HEALTH_SQL
    + """SELECT model_id, CASE WHEN degraded OR ratio > 0.5 THEN 'critical' WHEN ratio > 0.3 THEN 'warning' ELSE 'healthy' END AS health
FROM whole_drift JOIN perf USING (model_id) WHERE contains(model_id, 'i')""",
)
def health_list(t):
    return P.health_list(model_health(t), search="I")


@query(
    "distribution_sides",
    f"""WITH e AS (SELECT value, CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'current' ELSE 'reference' END AS side FROM events),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM e)
SELECT side, least(29, floor((value - lo) / (hi - lo) * 30)::INT) AS bin, count(*) AS n,
       round(lo + least(29, floor((value - lo) / (hi - lo) * 30)::INT) * ((hi - lo) / 30), 6) AS lower,
       round(lo + (least(29, floor((value - lo) / (hi - lo) * 30)::INT) + 1) * ((hi - lo) / 30), 6) AS upper
FROM e, r GROUP BY ALL""",
)
def distribution_sides(t):
    return rounded(V.distributions(D.sides(*event_sides(t), ["value"]), "value"))


@query(
    "latest_window_drift",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
w AS (SELECT event_type, value, r <= 500 AS cur FROM ranked WHERE r <= 500 + 1000),
sizes AS (SELECT event_type, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur FROM w GROUP BY 1),
counts AS (SELECT event_type, value, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM w GROUP BY ALL),
cdf AS (SELECT event_type, sum(r) OVER o AS cr, sum(c) OVER o AS cc FROM counts WINDOW o AS (PARTITION BY event_type ORDER BY value))
SELECT event_type AS feature, n_ref, n_cur, round(max(abs(cr::DOUBLE / nullif(n_ref, 0) - cc::DOUBLE / nullif(n_cur, 0))), 6) AS statistic
FROM cdf JOIN sizes USING (event_type) GROUP BY ALL""",
)
def latest_window_drift(t):
    """The newest 500 rows of every event type against the 1000 before them, as one melted test."""
    both = H.comparison_windows(t.events, ["ts", "event_id"], ["event_type"], 500, 1000)
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = both.select(
        (F.col("side") == "current").alias("is_current"),
        *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds],
    )
    return rounded(D.ks_test(wide, kinds).select("feature", "n_ref", "n_cur", "statistic"))
