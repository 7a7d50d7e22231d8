"""Profile, typing, hashing and scoring-cache queries."""

from pyspark.sql import DataFrame, functions as F

from modelyard.functions import values as X
from modelyard.operators import profile as Q
from modelyard.operators import scoring as S
from modelyard.plans.catalog import Tables, query, rounded


def gappy(t: Tables) -> DataFrame:
    """`lineitem` with gaps put in by key: no given column has any."""
    key = F.col("l_orderkey") + F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(key % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        F.when(key % 13 != 0, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("l_discount"),
    )


GAPPY_SQL = """
WITH gappy AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_quantity END AS l_quantity,
         CASE WHEN (l_orderkey + l_linenumber) % 5 <> 0 THEN l_extendedprice END AS l_extendedprice,
         CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_returnflag END AS l_returnflag,
         CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN l_discount END AS l_discount
  FROM lineitem)
"""

MISSING_SQL = GAPPY_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS rows FROM gappy"
    for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")
)


@query("profile_missing", MISSING_SQL)
def profile_missing(t):
    return Q.missing_counts(gappy(t))


@query(
    "table_profile",
    GAPPY_SQL
    + """, facts AS (SELECT unnest(['l_orderkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_returnflag', 'l_discount']) AS column_name,
  unnest(['bigint', 'int', 'double', 'double', 'string', 'double']) AS data_type,
  unnest(['numeric', 'numeric', 'numeric', 'target', 'categorical', 'numeric']) AS role),
m AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS rows FROM gappy"
        for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")
    )
    + ") SELECT * FROM facts JOIN m USING (column_name)",
)
def table_profile(t):
    return Q.profile(gappy(t), "l_extendedprice")


@query("nan_to_null", GAPPY_SQL + "SELECT l_orderkey, l_linenumber, l_discount FROM gappy")
def nan_to_null(t):
    return X.nan_to_null(gappy(t)).select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "preview",
    "SELECT * FROM region ORDER BY r_regionkey LIMIT 5",
)
def preview(t):
    """All of `region`: the table has five rows."""
    return Q.preview(t.region)


@query(
    "value_counts",
    GAPPY_SQL
    + """SELECT l_returnflag AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share
FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1""",
)
def value_counts(t):
    return rounded(Q.value_counts(gappy(t), "l_returnflag"))


@query(
    "infer_task",
    """SELECT unnest(['l_returnflag', 'l_linenumber', 'l_extendedprice', 'l_orderkey']) AS target,
       unnest(['classification', 'classification', 'regression', 'regression']) AS task""",
)
def infer_task(t):
    targets = ["l_returnflag", "l_linenumber", "l_extendedprice", "l_orderkey"]
    rows = [(c, Q.infer_task(t.lineitem, c)) for c in targets]
    return t.spark.createDataFrame(rows, "target string, task string")


@query(
    "coerce_numbers",
    """SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, try_cast(event_type AS DOUBLE) AS kind FROM events""",
)
def coerce_numbers(t):
    found = F.get_json_object("props", "$.k")
    return t.events.select("event_id", X.to_number(found).alias("k"), X.to_number(F.col("event_type")).alias("kind"))


@query(
    "failed_numbers",
    """SELECT 'event_type' AS column_name, count(*) AS failed FROM events UNION ALL SELECT 'k', 0::BIGINT""",
)
def failed_numbers(t):
    df = t.events.select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return S.coercion_failures(df, ["event_type", "k"])


@query(
    "row_fingerprint",
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS fingerprint
FROM part""",
)
def row_fingerprint(t):
    return t.part.select("p_partkey", X.fingerprint(["p_size", "p_partkey", "p_brand"]).alias("fingerprint"))


@query("table_digest")
def table_digest(t):
    return X.table_digest(t.orders)


@query(
    "json_rows",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS body FROM events""",
)
def json_rows(t):
    return t.events.select("event_id", X.row_json(["event_id", "event_type"]).alias("body"))


@query(
    "sorted_json",
    """SELECT o_orderkey, '{"a":"' || o_orderstatus || '","b":"' || o_orderpriority || '"}' AS body FROM orders""",
)
def sorted_json(t):
    mapping = F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("a"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", X.sorted_json(mapping).alias("body"))


@query(
    "score_unseen",
    """SELECT p_partkey, round(p_retailprice * 2, 6) AS prediction, FALSE AS cached FROM part
WHERE (p_brand, p_size) NOT IN (SELECT (p_brand, p_size) FROM part WHERE p_retailprice > 1500)
UNION ALL SELECT p_partkey, (p_size * 10)::DOUBLE, TRUE FROM part
WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part WHERE p_retailprice > 1500)""",
)
def score_unseen(t):
    """Rows whose brand and size were scored before get the stored value; only the others reach the model."""
    inputs = ["p_brand", "p_size"]
    seen = t.part.where("p_retailprice > 1500").select(*inputs).distinct()
    cache = seen.select(
        X.fingerprint(inputs).alias("fingerprint"),
        (F.col("p_size") * 10).cast("double").alias("prediction"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("scored_at"),
    )
    out = S.score_with_cache(
        t.part,
        inputs,
        cache,
        lambda rows: rows.withColumn("prediction", F.col("p_retailprice") * 2),
        now=F.lit("2024-01-01 00:30:00").cast("timestamp"),
    )
    return rounded(out.select("p_partkey", "prediction", "cached"))


@query(
    "concatenated_batches",
    """SELECT o_orderkey, o_totalprice, NULL AS l_tax FROM orders UNION ALL SELECT l_orderkey, NULL, l_tax FROM lineitem""",
)
def concatenated_batches(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_tax")
    return S.concat_batches([t.orders.select("o_orderkey", "o_totalprice"), lines])


@query(
    "request_rows",
    """SELECT json_extract_string(props, '$.k')::DOUBLE AS k, count(*) AS n FROM events GROUP BY 1""",
)
def request_rows(t):
    """JSON request bodies as rows."""
    from modelyard.sources.readers import read_rows

    return read_rows(t.spark, t.events, "props", "k double").groupBy("k").agg(F.count("*").alias("n"))
