"""Alert queries over `events`: an error is an alert, the user is its key."""

from pyspark.sql import DataFrame, functions as F

from modelyard.operators import alerts as A
from modelyard.plans.catalog import Tables, query


def error_alerts(t: Tables) -> DataFrame:
    severity = F.when(F.col("value") > 100, "critical").when(F.col("value") > 50, "high").otherwise("low")
    found = A.alert_rows(
        t.events.withColumn("level", severity),
        F.col("event_type") == "error",
        "error_alert",
        ["user_id", "level"],
        F.col("ts"),
        F.col("level"),
    )
    return found


ALERTS_SQL = """
WITH alerts AS (
  SELECT event_id, user_id, ts, CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'high' ELSE 'low' END AS severity
  FROM events WHERE event_type = 'error')
"""


@query(
    "alert_rows",
    ALERTS_SQL
    + """SELECT 'error_alert' AS template, ts AS timestamp, severity,
       'error_alert_{"level":"' || severity || '","user_id":"' || user_id || '"}' AS alert_key,
       '{"level":"' || severity || '","user_id":"' || user_id || '"}' AS data FROM alerts""",
)
def alert_rows(t):
    return error_alerts(t).drop("recipients")


def _cooldown_sql(where: str, key: str, seconds: int) -> str:
    return f"""WITH RECURSIVE a AS (SELECT event_id, {key} AS k, ts FROM events WHERE {where}),
passes(k, ts) AS (
  SELECT k, min(ts) FROM a GROUP BY k
  UNION ALL
  SELECT k, ts FROM (
    SELECT a.k, min(a.ts) AS ts FROM passes p JOIN a ON a.k = p.k AND a.ts >= p.ts + INTERVAL {seconds} SECONDS GROUP BY a.k, p.ts))
SELECT event_id, EXISTS (SELECT 1 FROM passes p WHERE p.k = a.k AND p.ts = a.ts) AS passed FROM a"""


@query("alert_cooldown", _cooldown_sql("event_type = 'error'", "user_id", 86400))
def alert_cooldown(t):
    errors = t.events.where("event_type = 'error'")
    return A.cooldown(errors, ["user_id"], "ts", "event_id", 86400).select("event_id", "passed")


@query("alert_cooldown_hot_key", _cooldown_sql("TRUE", "event_type", 3600))
def alert_cooldown_hot_key(t):
    """Every event is an alert and there are only five keys."""
    return A.cooldown(t.events, ["event_type"], "ts", "event_id", 3600).select("event_id", "passed")


@query(
    "alert_history_kept",
    """SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1000""",
)
def alert_history_kept(t):
    from modelyard.operators.history import newest

    return newest(t.events.where("event_type = 'error'"), 1000, ["ts", "event_id"]).select("event_id")


@query(
    "alert_severity",
    ALERTS_SQL
    + """SELECT event_id, severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS rank
FROM alerts ORDER BY rank, event_id""",
)
def alert_severity(t):
    level = F.when(F.col("value") > 100, "critical").when(F.col("value") > 50, "high").otherwise("low")
    errors = t.events.where("event_type = 'error'").select("event_id", level.alias("severity"))
    return errors.withColumn("rank", A.severity_rank(F.col("severity"))).orderBy("rank", "event_id")


@query(
    "alert_totals",
    "SELECT count(*) AS total_alerts, max(ts) AS last_alert_time FROM events WHERE event_type = 'error'",
)
def alert_totals(t):
    return A.alert_totals(error_alerts(t))


@query("alerts_by_template", "SELECT event_type AS template, count(*) AS n FROM events GROUP BY 1")
def alerts_by_template(t):
    return A.alerts_by_template(t.events.withColumnRenamed("event_type", "template"))


@query(
    "top_recipients",
    """WITH r AS (
  SELECT 'user' || user_id AS recipient FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'team' || (user_id % 7) FROM events WHERE event_type = 'error')
SELECT recipient, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def top_recipients(t):
    recipients = F.array(
        F.concat(F.lit("user"), F.col("user_id").cast("string")),
        F.concat(F.lit("team"), (F.col("user_id") % 7).cast("string")),
    )
    return A.top_recipients(t.events.where("event_type = 'error'").withColumn("recipients", recipients))
