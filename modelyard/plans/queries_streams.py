"""Stream, store and file queries: data derived from the given tables goes through a real sink and is read back."""

from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import assemble
from modelyard.operators.history import latest_per_key
from modelyard.operators.models import estimator
from modelyard.plans.catalog import Tables, query, rounded
from modelyard.plans.queries_models import scratch
from modelyard.sources import readers as R
from modelyard.sources.store import Store
from modelyard.streaming import jobs as J


def stream_of(t: Tables, name: str) -> DataFrame:
    """A given table as a file stream."""
    table = t.spark.read.parquet(f"{t.folder}/{name}.parquet")
    stream = t.spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in table.schema.fields if "timestamp" in f.dataType.simpleString()})


HOURLY_SQL = """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS total,
       count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS error
FROM events GROUP BY 1"""


@query("hourly_monitor", HOURLY_SQL)
def hourly_monitor(t):
    """The batch form of the stream counters."""
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    return J.window_counters(t.events.withColumn("status", status), "ts", "status")


@query("stream_counters", HOURLY_SQL)
def stream_counters(t):
    folder = scratch(t, "counters")
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    J.run_counters(stream_of(t, "events").withColumn("status", status), folder, "ts", "status").awaitTermination()
    return J.read_latest(t.spark, folder, ["window_start"])


@query(
    "stream_scoring",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 4) AS prediction FROM lineitem, m""",
)
def stream_scoring(t):
    features = assemble(["l_quantity"]).alias("features")
    model = estimator("linear_regression", "regression").fit(t.lineitem.select(features, F.col("l_extendedprice").alias("label")))
    folder = scratch(t, "scoring")
    keys = ["l_orderkey", "l_linenumber"]
    J.run_scoring(stream_of(t, "lineitem").select(*keys, features), model, folder, keys).awaitTermination()
    return rounded(t.spark.read.parquet(f"{folder}/data"), 4)


@query(
    "stream_monitoring",
    """WITH ref AS (SELECT value, count(*) AS r FROM events GROUP BY 1),
days AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, value, count(*) AS c FROM events GROUP BY ALL),
closed AS (
  SELECT DISTINCT d FROM days
  WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
both_sides AS (
  SELECT closed.d, ref.value, ref.r, coalesce(days.c, 0) AS c
  FROM closed CROSS JOIN ref LEFT JOIN days ON days.d = closed.d AND days.value = ref.value),
cdf AS (
  SELECT d, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY d) AS nr, sum(c) OVER (PARTITION BY d) AS nc
  FROM both_sides WINDOW w AS (PARTITION BY d ORDER BY value)),
ks AS (SELECT d, max(nc) AS n, max(abs(cr::DOUBLE / nr - cc::DOUBLE / nc)) AS s FROM cdf GROUP BY 1)
SELECT d AS window_start, 'value' AS feature, n::BIGINT AS n_cur, CASE WHEN n >= 300 THEN round(s, 6) END AS statistic,
       n < 300 AS skipped FROM ks""",
)
def stream_monitoring(t):
    """One drift check per closed day, the whole table as the reference; small days are reported as skipped."""
    folder = scratch(t, "monitoring")
    stream = stream_of(t, "events")
    J.run_monitoring(stream, t.events, folder, "ts", ["value"], "1 day", "1 hour", min_rows=300).awaitTermination()
    found = t.spark.read.parquet(f"{folder}/data").drop("batch", "part")
    return rounded(
        found.select("window_start", "feature", "n_cur", "statistic", (F.col("status") == "skipped").alias("skipped"))
    )


@query(
    "stream_cooldown",
    """WITH RECURSIVE a AS (SELECT event_id, user_id AS k, ts FROM events WHERE event_type = 'error'),
passes(k, ts) AS (
  SELECT k, min(ts) FROM a GROUP BY k
  UNION ALL
  SELECT k, ts FROM (
    SELECT a.k, min(a.ts) AS ts FROM passes p JOIN a ON a.k = p.k AND a.ts >= p.ts + INTERVAL 86400 SECONDS GROUP BY a.k, p.ts))
SELECT event_id, EXISTS (SELECT 1 FROM passes p WHERE p.k = a.k AND p.ts = a.ts) AS passed FROM a""",
)
def stream_cooldown(t):
    folder = scratch(t, "cooldown")
    errors = stream_of(t, "events").where("event_type = 'error'")
    J.start(J.streaming_cooldown(errors, "user_id", "ts", "event_id", 86400), folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/data").select("event_id", "passed")


@query(
    "training_progress",
    """SELECT user_id AS model_id, arg_max(event_type, event_id) AS step, round(arg_max(value, event_id), 6) AS progress
FROM events GROUP BY 1""",
)
def training_progress(t):
    events = t.events.select(
        F.col("user_id").alias("model_id"), F.col("event_id").alias("at"), F.col("event_type").alias("step"), F.col("value").alias("progress")
    )
    return rounded(latest_per_key(events, ["at"], ["model_id"]).drop("at"))


@query(
    "prediction_log",
    """SELECT strftime(ts, '%Y%m%d') AS pred_date, event_type AS model_id, count(*) AS n, round(avg(value), 6) AS confidence FROM events GROUP BY ALL""",
)
def prediction_log(t):
    """Events as predictions, logged into one folder per day and read back."""
    store = Store(t.spark, scratch(t, "log"))
    rows = t.events.select(
        F.col("event_type").alias("model_id"),
        F.col("props").alias("input_data"),
        F.col("user_id").cast("string").alias("prediction"),
        F.col("ts").alias("prediction_time"),
        F.col("value").alias("confidence"),
    )
    store.append("predictions", rows)
    log = store.read("predictions").groupBy("pred_date", "model_id")
    return rounded(log.agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")))


@query(
    "store_latest_models",
    """WITH r AS (SELECT o_custkey::VARCHAR AS model_id, o_orderpriority AS version, o_orderstatus AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT model_id, version, status FROM r WHERE r = 1""",
)
def store_latest_models(t):
    """Orders as versions of a customer's model, appended and read back as the latest rows."""
    store = Store(t.spark, scratch(t, "models"))
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("model_id"),
        F.col("o_orderpriority").alias("version"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("last_updated"),
    )
    store.append("models", rows)
    return store.models().select("model_id", "version", "status")


@query(
    "store_delete",
    """SELECT event_type AS model_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def store_delete(t):
    """Deleting a model takes its drift rows along."""
    store = Store(t.spark, scratch(t, "delete"))
    rows = t.events.select(
        F.col("event_type").alias("model_id"), F.col("ts").alias("detection_time"), F.col("value").alias("drift_score")
    )
    store.append("data_drift", rows)
    store.delete_model("error")
    return store.read("data_drift").groupBy("model_id").agg(F.count("*").alias("n"))


@query(
    "csv_detected",
    """SELECT c_custkey::INTEGER AS c_custkey, c_name || ' é' AS c_name, c_acctbal, c_mktsegment FROM customer""",
)
def csv_detected(t):
    """Customers as a semicolon file in a one-byte encoding; both are found out on reading."""
    folder = scratch(t, "customers") + ".csv"
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_acctbal", "c_mktsegment")
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(folder)
    return R.read_table(t.spark, folder)


@query("json_read", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def json_read(t):
    folder = scratch(t, "orders") + ".json"
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").write.json(folder)
    return R.read_table(t.spark, folder, schema="o_orderkey long, o_totalprice double, o_orderstatus string")


@query("parquet_read", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def parquet_read(t):
    return R.read_table(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "log_counts",
    """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS logger, count(*) AS n FROM events GROUP BY ALL""",
)
def log_counts(t):
    """Events as structured log lines."""
    folder = scratch(t, "logs")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    lines = t.events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        level.alias("level"),
        F.col("event_type").alias("logger"),
        F.col("props").alias("message"),
        F.lit("events").alias("module"),
        F.lit("emit").alias("function"),
        F.lit(1).alias("line"),
    )
    lines.write.json(folder)
    return R.log_counts(R.read_logs(t.spark, folder))
