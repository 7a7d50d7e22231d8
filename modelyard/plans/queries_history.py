"""History, statistics, registry and report queries. Orders, events and parts play the history tables."""

from pyspark.sql import DataFrame, functions as F

from modelyard.functions import text as X
from modelyard.operators import history as H
from modelyard.operators import performance as P
from modelyard.operators import reports as V
from modelyard.plans.catalog import Tables, query, rounded


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_per_key(t):
    orders = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    latest = H.latest_per_key(orders, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice")


def _newest_sql(n: int, key: str, columns: str, table: str, order: str) -> str:
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {table}) WHERE r <= {n}"""


@query(
    "versions_kept",
    _newest_sql(5, "o_custkey", "o_custkey, o_orderkey, o_totalprice", "orders", "o_orderdate DESC, o_orderkey DESC"),
)
def versions_kept(t):
    kept = H.newest(t.orders, 5, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "retention_last_n",
    _newest_sql(1000, "o_orderpriority", "o_orderpriority, o_orderkey", "orders", "o_orderdate DESC, o_orderkey DESC"),
)
def retention_last_n(t):
    kept = H.newest(t.orders, 1000, ["o_orderdate", "o_orderkey"], ["o_orderpriority"])
    return kept.select("o_orderpriority", "o_orderkey")


@query(
    "comparison_windows",
    """SELECT o_orderpriority, CASE WHEN r <= 1000 THEN 'current' ELSE 'reference' END AS side, count(*) AS n,
       round(avg(o_totalprice), 4) AS mean
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
WHERE r <= 11000 GROUP BY ALL""",
)
def comparison_windows(t):
    tagged = H.comparison_windows(t.orders, ["o_orderdate", "o_orderkey"], ["o_orderpriority"], 1000, 10000)
    out = tagged.groupBy("o_orderpriority", "side").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return rounded(out, 4)


def _models(t: Tables) -> DataFrame:
    """Parts as models: brand as the task, size as the version."""
    return t.part.select(
        F.col("p_name").alias("model_id"),
        F.col("p_brand").alias("task_type"),
        F.when(F.col("p_size") > 25, "active").otherwise("archived").alias("status"),
        F.col("p_partkey").alias("creation_date"),
        F.col("p_retailprice").alias("accuracy"),
    )


MODELS_SQL = """
WITH models AS (
  SELECT p_name AS model_id, p_brand AS task_type, CASE WHEN p_size > 25 THEN 'active' ELSE 'archived' END AS status,
         p_partkey AS creation_date, p_retailprice AS accuracy FROM part)
"""


@query(
    "registry_list",
    MODELS_SQL + "SELECT * FROM models WHERE status = 'active' AND contains(lower(model_id || task_type), 'brand#1') ORDER BY accuracy DESC",
)
def registry_list(t):
    return H.registry_list(_models(t), status="active", search="BRAND#1", sort_by="accuracy")


@query("registry_by_date", MODELS_SQL + "SELECT * FROM models ORDER BY creation_date DESC")
def registry_by_date(t):
    return H.registry_list(_models(t))


@query("active_models", MODELS_SQL + "SELECT * FROM models WHERE status = 'active'")
def active_models(t):
    return H.registry_list(_models(t), status="active", sort_by="creation_date", descending=False)


@query(
    "model_overview",
    MODELS_SQL + "SELECT task_type, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total_models FROM models GROUP BY 1",
)
def model_overview(t):
    return H.model_overview(_models(t))


@query(
    "registry_page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows,
       (SELECT ceil(count(*) / 25)::BIGINT FROM orders) AS total_pages
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def registry_page(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return H.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], number=3, size=25)


@query(
    "prediction_list",
    """SELECT event_id, event_type, value FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""",
)
def prediction_list(t):
    predictions = t.events.select(
        "event_id",
        F.col("event_type").alias("model_id"),
        F.col("ts").alias("prediction_time"),
        F.col("value").alias("prediction"),
    )
    found = H.prediction_list(predictions, "click", F.lit("2024-01-10"))
    return found.select("event_id", F.col("model_id").alias("event_type"), F.col("prediction").alias("value"))


@query(
    "derived_columns",
    """SELECT o_orderkey, floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 86400)::INT AS age_days,
       CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice > 200000) = (o_orderstatus = 'F') END AS is_correct,
       CASE WHEN o_orderstatus = 'F' THEN epoch(TIMESTAMP '2000-01-01' - o_orderdate)::DOUBLE ELSE 0.0 END AS duration_seconds
FROM orders""",
)
def derived_columns(t):
    now = F.lit("2000-01-01").cast("timestamp")
    df = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").alias("creation_date"),
        F.col("o_orderdate").alias("start_time"),
        F.when(F.col("o_orderstatus") == "F", now).alias("end_time"),
        (F.col("o_totalprice") > 200000).alias("prediction"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("actual_value"),
    )
    df = H.with_duration(H.with_correctness(H.with_age(df, now)))
    return df.select("o_orderkey", "age_days", "is_correct", "duration_seconds")


@query(
    "model_children",
    """SELECT c_custkey, c_mktsegment, count(o_orderkey) AS predictions, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
)
def model_children(t):
    """Parent and child rows by key; children are summed before the join, so a hot parent is one row."""
    children = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("predictions"), F.sum("o_totalprice").alias("total")
    )
    joined = t.customer.select("c_custkey", "c_mktsegment").join(children, "c_custkey", "left")
    return rounded(joined.fillna({"predictions": 0, "total": 0.0}), 2)


@query(
    "cascade_delete",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def cascade_delete(t):
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti")


@query(
    "prediction_stats",
    """SELECT count(*) AS total_predictions, count(DISTINCT event_type) AS unique_predictions, max(ts) AS last_prediction_time FROM events""",
)
def prediction_stats(t):
    return H.prediction_stats(t.events, "event_type", "ts")


@query(
    "service_rates",
    """SELECT user_id, count(*) AS n, round(avg(value), 6) AS average_response_time,
       round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg((event_type = 'error')::INT), 6) AS error_rate
FROM events GROUP BY 1""",
)
def service_rates(t):
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    return rounded(H.service_rates(t.events.withColumn("status", status), "status", "value", ["user_id"]))


@query(
    "service_rates_default",
    "SELECT count(*) AS n, round(avg(value), 6) AS average_response_time, 1.0::DOUBLE AS success_rate, 0.0::DOUBLE AS error_rate FROM events",
)
def service_rates_default(t):
    return rounded(H.service_rates(t.events, None, "value"))


@query(
    "confidence_describe",
    """WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, min(l_extendedprice) AS lo,
  max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS metric,
       unnest([n, round(m, 4), round(s, 4), lo, round(q[1], 4), round(q[2], 4), round(q[3], 4), hi]) AS value FROM s""",
)
def confidence_describe(t):
    return rounded(H.describe(t.lineitem, "l_extendedprice"), 4)


def _updates(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("model_id"),
        "o_orderkey",
        F.col("o_orderdate").alias("timestamp"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.sqrt("o_totalprice").alias("improvement"),
    )


@query(
    "update_statistics",
    """WITH u AS (
  SELECT o_custkey AS model_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s, avg(sqrt(o_totalprice)) AS i,
         max(o_orderdate) AS last, CASE WHEN count(*) > 1 THEN epoch(max(o_orderdate) - min(o_orderdate))::DOUBLE / (count(*) - 1) END AS gap
  FROM orders GROUP BY 1)
SELECT model_id, n AS total_updates, s AS successful_updates, round(i, 4) AS average_improvement, last AS last_update,
       round(gap, 4) AS mean_interval_seconds,
       CASE WHEN gap IS NULL THEN 'غير متوفر' WHEN gap < 3600 THEN 'كل ' || floor(gap / 60)::BIGINT || ' دقيقة'
            WHEN gap < 86400 THEN 'كل ' || floor(gap / 3600)::BIGINT || ' ساعة'
            ELSE 'كل ' || floor(gap / 86400)::BIGINT || ' يوم' END AS update_frequency
FROM u""",
)
def update_statistics(t):
    return rounded(H.update_statistics(_updates(t), ["model_id"]), 4)


@query(
    "update_intervals",
    """SELECT o_custkey AS model_id, o_orderkey,
       epoch(o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::DOUBLE AS interval_seconds
FROM orders""",
)
def update_intervals(t):
    gaps = H.intervals(_updates(t), "timestamp", ["model_id"], ["o_orderkey"])
    return gaps.select("model_id", "o_orderkey", "interval_seconds")


@query(
    "improvement",
    """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_orderkey, round((o_totalprice - before) / before, 6) AS improvement,
       round(CASE WHEN before IS NULL OR before = 0 THEN 0 ELSE (o_totalprice - before) / before * 100 END, 6) AS improvement_pct
FROM s""",
)
def improvement(t):
    from modelyard.operators.ordered import with_previous

    stepped = with_previous(t.orders, ["o_totalprice"], "o_orderdate", ["o_custkey"], ["o_orderkey"])
    before, after = F.col("prev_o_totalprice"), F.col("o_totalprice")
    return rounded(
        stepped.select(
            "o_orderkey",
            P.improvement(before, after).alias("improvement"),
            P.improvement_percent(before, after).alias("improvement_pct"),
        )
    )


@query(
    "recent_updates",
    """SELECT o_custkey AS model_id, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
)
def recent_updates(t):
    return H.newest(_updates(t), 20, ["timestamp", "o_orderkey"]).select("model_id", "o_orderkey")


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in NAMES))
def row_counts(t):
    return H.row_counts({n: getattr(t, n) for n in NAMES})


@query(
    "monitoring_header",
    """SELECT (SELECT count(*) FROM part WHERE p_size > 25) AS active_models, (SELECT count(*) FROM events) AS total_predictions,
       (SELECT round(avg(l_discount) * 100, 6) FROM lineitem) AS mean_performance,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS drift_alerts""",
)
def monitoring_header(t):
    drift = t.events.select((F.col("event_type") == "error").alias("drift_detected"))
    metrics = t.lineitem.select(F.col("l_discount").alias("value"))
    return rounded(H.monitoring_header(_models(t), t.events, metrics, drift))


@query(
    "prediction_counts",
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY ALL",
)
def prediction_counts(t):
    return V.prediction_counts(t.events, "ts", "day", ["event_type"])


@query(
    "prediction_histogram",
    """WITH v AS (
  SELECT 'prediction' AS side, 1000.0 * l_quantity + 20000.0 * l_discount + 28000.0 AS value FROM lineitem
  UNION ALL SELECT 'actual', l_extendedprice FROM lineitem),
r AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
b AS (SELECT side, least(29, floor((value - lo) / (hi - lo) * 30)::INT) AS bin, count(*) AS n FROM v, r GROUP BY ALL)
SELECT side, bin, n, round(lo + bin * ((hi - lo) / 30), 4) AS lower, round(lo + (bin + 1) * ((hi - lo) / 30), 4) AS upper FROM b, r""",
)
def prediction_histogram(t):
    from modelyard.plans.queries_evaluation import fitted

    return rounded(V.prediction_histogram(fitted(t), "p", "y"), 4)


@query(
    "error_distribution",
    """WITH h AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
l AS (SELECT user_id, max(day) AS day FROM h GROUP BY 1)
SELECT user_id, event_type AS name, n AS value FROM h JOIN l USING (user_id, day)""",
)
def error_distribution(t):
    day = F.date_trunc("day", F.col("ts")).alias("day")
    counts = t.events.groupBy("user_id", day, "event_type").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("user_id", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("errors")
    )
    return V.error_distribution(maps, ["user_id"], ["day"], "errors")


@query(
    "top_features",
    "SELECT p_name AS feature_name, p_retailprice AS importance_score FROM part ORDER BY 2 DESC, 1 LIMIT 15",
)
def top_features(t):
    return V.top_features(
        t.part.select(F.col("p_name").alias("feature_name"), F.col("p_retailprice").alias("importance_score"))
    )


@query(
    "report_list",
    """SELECT o_orderkey AS report_id, o_orderpriority AS report_type, o_custkey AS model_id FROM orders
WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey""",
)
def report_list(t):
    reports = t.orders.select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_orderpriority").alias("report_type"),
        F.col("o_custkey").alias("model_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    return V.report_list(reports, kind="1-URGENT").drop("created_at")


@query(
    "compare_models",
    """SELECT l_shipmode_stub AS model_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n,
       avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) = max(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)) OVER () AS best
FROM (SELECT 'by_quantity' AS l_shipmode_stub, (l_quantity > 25) = (l_returnflag = 'R') AS hit FROM lineitem
      UNION ALL SELECT 'by_price', (l_extendedprice > 50000) = (l_returnflag = 'R') FROM lineitem
      UNION ALL SELECT 'by_tax', (l_tax > 0.04) = (l_returnflag = 'R') FROM lineitem) GROUP BY 1""",
)
def compare_models(t):
    from modelyard.operators.comparison import mark_best

    truth = F.col("l_returnflag") == "R"
    hits = {"by_quantity": F.col("l_quantity") > 25, "by_price": F.col("l_extendedprice") > 50000, "by_tax": F.col("l_tax") > 0.04}
    rows = t.lineitem.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("model_id"), (c == truth).alias("hit")) for n, c in hits.items()]))
    )
    table = rows.groupBy("model_id").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return rounded(mark_best(table, "accuracy"))


FORMATS_SQL = """
SELECT o_orderkey, upper(replace('model_' || o_orderstatus, '_', ' ')) AS label,
       upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS capital,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, contains(lower(o_orderpriority), 'high') AS found
FROM orders"""


@query("text_formats", FORMATS_SQL)
def text_formats(t):
    return t.orders.select(
        "o_orderkey",
        X.display_label(F.concat(F.lit("model_"), F.col("o_orderstatus"))).alias("label"),
        X.capitalise(F.col("o_orderpriority")).alias("capital"),
        X.time_text(F.col("o_orderdate").cast("string")).alias("stamp"),
        X.matches_search("HIGH", F.col("o_orderpriority")).alias("found"),
    )


@query(
    "number_format",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,}', trunc(abs(c_acctbal))::BIGINT) || '.' ||
  CASE WHEN round(abs(c_acctbal) * 100)::BIGINT % 100 = 0 THEN '0'
       ELSE rtrim(lpad((round(abs(c_acctbal) * 100)::BIGINT % 100)::VARCHAR, 2, '0'), '0') END AS balance
FROM customer""",
)
def number_format(t):
    return t.customer.select("c_custkey", X.grouped_number(F.col("c_acctbal")).alias("balance"))


@query(
    "duration_format",
    """WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders),
p AS (SELECT o_orderkey, n, n // 86400 AS d, n % 86400 // 3600 AS h, n % 3600 // 60 AS m, n % 60 AS s FROM s)
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN d > 0 THEN d || ' يوم' END, CASE WHEN h > 0 THEN h || ' ساعة' END, CASE WHEN m > 0 THEN m || ' دقيقة' END,
  CASE WHEN s > 0 OR n = 0 THEN s || ' ثانية' END], lambda x: x IS NOT NULL), ' و ') AS duration
FROM p""",
)
def duration_format(t):
    return t.orders.select("o_orderkey", X.duration_text(F.col("o_totalprice")).alias("duration"))


@query(
    "iso_times",
    """SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
       round(sqrt(value * value + user_id * user_id), 6) AS norm FROM events""",
)
def iso_times(t):
    from modelyard.functions.vectors import norm

    both = F.array(F.col("value"), F.col("user_id").cast("double"))
    return rounded(t.events.select("event_id", X.iso_text(F.col("ts")).alias("iso"), norm(both).alias("norm")))


@query(
    "paired_accuracy",
    """SELECT count(*) AS n, round(avg(((d.n_chars > 2000) = (l.toxic = 1))::INT), 6) AS accuracy
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def paired_accuracy(t):
    from modelyard.operators.scoring import pair_actuals

    predictions = t.documents.select("doc_id", (F.col("n_chars") > 2000).alias("prediction"))
    actuals = t.labels.select("doc_id", (F.col("toxic") == 1).alias("actual_value"))
    paired = H.with_correctness(pair_actuals(predictions, actuals, ["doc_id"]))
    return rounded(paired.agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")))


@query(
    "evaluation_envelope",
    """WITH e AS (SELECT l_extendedprice - (1000.0 * l_quantity + 20000.0 * l_discount + 28000.0) AS e FROM lineitem),
m AS (SELECT avg(abs(e)) AS mae, max(abs(e)) AS top FROM e)
SELECT unnest(['mae', 'max_error']) AS metric, unnest([round(mae, 4), round(top, 4)]) AS value, 'regression' AS task_type,
       (SELECT count(*) FROM lineitem) AS n_samples, 2 AS n_features, TIMESTAMP '2024-01-01' AS timestamp FROM m""",
)
def evaluation_envelope(t):
    from modelyard.operators.regression import regression_metrics
    from modelyard.plans.pipelines import envelope
    from modelyard.plans.queries_evaluation import fitted

    rows = fitted(t)
    metrics = regression_metrics(rows, "y", "p").where(F.col("metric").isin("mae", "max_error"))
    now = F.lit("2024-01-01").cast("timestamp")
    return rounded(envelope(metrics, rows, ["l_quantity", "l_discount"], "regression", now), 4)


@query(
    "model_report",
    """SELECT 'info' AS section, count(*) AS n FROM part UNION ALL SELECT 'metrics', 7::BIGINT
UNION ALL SELECT 'confusion', 9::BIGINT UNION ALL SELECT 'importance', 15::BIGINT
UNION ALL SELECT 'history', count(DISTINCT (event_type, date_trunc('day', ts))) FROM events""",
)
def model_report(t):
    """The rows of every section of a report over the given tables."""
    from modelyard.operators.classification import classification_metrics, confusion_matrix
    from modelyard.plans.queries_drift import daily_series
    from modelyard.plans.queries_evaluation import flags

    rows = flags(t)
    report = V.model_report(
        _models(t),
        classification_metrics(rows, "label", "prediction"),
        confusion_matrix(rows, "label", "prediction"),
        top_features(t),
        daily_series(t),
    )
    return report.groupBy("section").agg(F.count("*").alias("n"))


@query(
    "monitoring_report",
    """SELECT 'alerts' AS section, count(*) AS n FROM events WHERE event_type = 'error'
UNION ALL SELECT 'performance', count(DISTINCT event_type) FROM events UNION ALL SELECT 'drift', count(DISTINCT (event_type, date_trunc('day', ts))) FROM events
UNION ALL SELECT 'predictions', 1::BIGINT""",
)
def monitoring_report(t):
    from modelyard.plans.queries_alerts import error_alerts
    from modelyard.plans.queries_drift import daily_series, drift_table

    history = daily_series(t)
    latest = H.latest_per_key(history, ["timestamp"], ["model_id"]).select("model_id", "value")
    report = V.monitoring_report(
        error_alerts(t), P.check_performance(latest, history), drift_table(t), prediction_stats(t)
    )
    return report.groupBy("section").agg(F.count("*").alias("n"))


@query(
    "documentation",
    """SELECT 'metric' AS section, 'mean' AS name, round(avg(o_totalprice), 2)::VARCHAR AS detail FROM orders
UNION ALL SELECT 'target', 'o_totalprice', 'double' UNION ALL SELECT 'output', 'prediction', 'double'
UNION ALL SELECT unnest(['feature', 'feature', 'feature', 'feature', 'input', 'input', 'input', 'input']),
  unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority', 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']),
  unnest(['numeric bigint', 'numeric bigint', 'categorical string', 'categorical string', 'bigint', 'bigint', 'string', 'string'])""",
)
def documentation(t):
    metrics = t.orders.agg(F.lit("mean").alias("metric"), F.round(F.avg("o_totalprice"), 2).alias("value"))
    return V.documentation(t.orders, "o_totalprice", metrics)
