"""Feature preparation queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import assemble
from modelyard.operators import encode as E
from modelyard.operators import impute as I
from modelyard.operators import outliers as O
from modelyard.operators import prepare as P
from modelyard.operators import scale as S
from modelyard.operators import select as C
from modelyard.operators import split as L
from modelyard.plans.catalog import query, rounded
from modelyard.plans.queries_profile import GAPPY_SQL, gappy

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(t) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", *NUMBERS)


def _scaled_sql(centre: str, width: str) -> str:
    cells = ", ".join(
        f"round(({c} - {centre.format(c=c)}) / CASE WHEN {width.format(c=c)} = 0 THEN 1 ELSE {width.format(c=c)} END, 6) AS {c}"
        for c in NUMBERS
    )
    stats = ", ".join(
        f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}, min({c}) AS lo_{c}, "
        f"max({c}) AS hi_{c}, max(abs({c})) AS a_{c}"
        for c in NUMBERS
    )
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cells} FROM lineitem, s"


SCALERS = {
    "robust": _scaled_sql("q_{c}[2]", "(q_{c}[3] - q_{c}[1])"),
    "standard": _scaled_sql("m_{c}", "d_{c}"),
    "minmax": _scaled_sql("lo_{c}", "(hi_{c} - lo_{c})"),
    "maxabs": _scaled_sql("0", "a_{c}"),
}


def _register_scaler(method: str, sql: str) -> None:
    @query(f"{method}_scale", sql)
    def scale(t):
        df = _lines(t)
        return rounded(S.apply_scaler(df, S.fit_scaler(df, NUMBERS, method)))


for _method, _sql in SCALERS.items():
    _register_scaler(_method, _sql)


@query(
    "exact_percentiles",
    """SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS column_name,
       unnest([round(quantile_cont(l_quantity, 0.1), 6), round(quantile_cont(l_extendedprice, 0.1), 6),
               round(quantile_cont(l_discount, 0.1), 6), round(quantile_cont(l_tax, 0.1), 6)]) AS p10,
       unnest([round(quantile_cont(l_quantity, 0.999), 6), round(quantile_cont(l_extendedprice, 0.999), 6),
               round(quantile_cont(l_discount, 0.999), 6), round(quantile_cont(l_tax, 0.999), 6)]) AS p999
FROM lineitem""",
)
def exact_percentiles(t):
    from modelyard.operators.ordered import exact_percentiles

    found = exact_percentiles(t.lineitem, NUMBERS, [0.1, 0.999])
    rows = [(c, *v) for c, v in found.items()]
    return rounded(t.spark.createDataFrame(rows, "column_name string, p10 double, p999 double"))


@query("power_transform")
def power_transform(t):
    df = _lines(t)
    return S.apply_power(df, S.fit_power(df, ["l_quantity", "l_extendedprice"]))


ONE_HOT_SQL = """
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missing' ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, """ + ", ".join(
    f"(seg = '{v}')::INT::DOUBLE AS \"segment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing")
) + " FROM c"


@query("one_hot_drop_first", ONE_HOT_SQL)
def one_hot_drop_first(t):
    df = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return E.one_hot(df, E.categories(df, ["segment"]), keep=["c_custkey"])


@query(
    "label_encode",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code FROM orders",
)
def label_encode(t):
    coded = E.label_encode(t.orders, "o_orderpriority", output="code")
    return coded.select("o_orderkey", "code")


@query(
    "label_encode_numbers",
    "SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_quantity) - 1)::DOUBLE AS code FROM lineitem",
)
def label_encode_numbers(t):
    return E.label_encode(t.lineitem, "l_quantity", output="code").select("l_orderkey", "l_linenumber", "code")


@query(
    "ordinal_encode",
    """SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand,
       (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type FROM part""",
)
def ordinal_encode(t):
    return E.ordinal_encode(t.part, ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


@query(
    "rare_to_other",
    """WITH top AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE '__other__' END AS p_brand FROM part""",
)
def rare_to_other(t):
    keep = E.frequent_categories(t.part, "p_brand", 10)
    return E.group_rare(t.part, "p_brand", keep).select("p_partkey", "p_brand")


def _fill_sql(quantity: str, price: str) -> str:
    return GAPPY_SQL + f"""SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, {quantity}), 6) AS l_quantity,
       round(coalesce(l_extendedprice, {price}), 6) AS l_extendedprice FROM gappy"""


FILLS = {
    "mean": _fill_sql("(SELECT avg(l_quantity) FROM gappy)", "(SELECT avg(l_extendedprice) FROM gappy)"),
    "median": _fill_sql(
        "(SELECT quantile_cont(l_quantity, 0.5) FROM gappy)", "(SELECT quantile_cont(l_extendedprice, 0.5) FROM gappy)"
    ),
    "most_frequent": _fill_sql(
        "(SELECT l_quantity FROM gappy WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        "(SELECT l_extendedprice FROM gappy WHERE l_extendedprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    ),
    "constant": _fill_sql("-1.0", "-1.0"),
}


def _register_fill(strategy: str, sql: str) -> None:
    @query(f"impute_{strategy}", sql)
    def fill(t):
        df = gappy(t).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        fitted = I.fit_simple(df, ["l_quantity", "l_extendedprice"], strategy, -1.0)
        return rounded(I.apply_simple(df, fitted))


for _strategy, _sql in FILLS.items():
    _register_fill(_strategy, _sql)


@query(
    "impute_category",
    GAPPY_SQL + "SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, 'missing') AS l_returnflag FROM gappy",
)
def impute_category(t):
    return gappy(t).select("l_orderkey", "l_linenumber", E.filled("l_returnflag").alias("l_returnflag"))


@query("iterative_impute")
def iterative_impute(t):
    df = gappy(t)
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    filled = I.fit_iterative(df, columns).transform(df)
    return rounded(filled.select("l_orderkey", "l_linenumber", *columns))


KNN_FILL_SQL = """
WITH p AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_size END::DOUBLE AS a,
         CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 100 END AS b FROM part),
near_a AS (
  SELECT x.k, y.a, row_number() OVER (PARTITION BY x.k ORDER BY sqrt((y.b - x.b) * (y.b - x.b) * 2), y.k) AS r
  FROM p x JOIN p y ON x.a IS NULL AND y.a IS NOT NULL AND x.b IS NOT NULL AND y.b IS NOT NULL),
near_b AS (
  SELECT x.k, y.b, row_number() OVER (PARTITION BY x.k ORDER BY sqrt((y.a - x.a) * (y.a - x.a) * 2), y.k) AS r
  FROM p x JOIN p y ON x.b IS NULL AND y.b IS NOT NULL AND x.a IS NOT NULL AND y.a IS NOT NULL),
fill_a AS (SELECT k, avg(a) AS v FROM near_a WHERE r <= 5 GROUP BY 1),
fill_b AS (SELECT k, avg(b) AS v FROM near_b WHERE r <= 5 GROUP BY 1)
SELECT p.k AS p_partkey, round(coalesce(a, fill_a.v, (SELECT avg(a) FROM p)), 4) AS p_size,
       round(coalesce(b, fill_b.v, (SELECT avg(b) FROM p)), 4) AS p_retailprice
FROM p LEFT JOIN fill_a ON fill_a.k = p.k LEFT JOIN fill_b ON fill_b.k = p.k"""


@query("knn_impute", KNN_FILL_SQL)
def knn_impute(t):
    """Size and price of parts, with gaps by key."""
    df = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") / 100).alias("p_retailprice"),
    )
    return rounded(I.knn_impute(df, ["p_size", "p_retailprice"], "p_partkey"), 4)


@query(
    "mutual_information",
    """WITH base AS (
  SELECT o_orderstatus AS y, o_orderpriority, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (
  SELECT 'o_orderpriority' AS feature, o_orderpriority AS x, y FROM base
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, y FROM base UNION ALL SELECT 'c_nationkey', c_nationkey, y FROM base),
c AS (
  SELECT feature, x, y, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY feature, x))::DOUBLE AS nx,
         (sum(count(*)) OVER (PARTITION BY feature, y))::DOUBLE AS ny, (sum(count(*)) OVER (PARTITION BY feature))::DOUBLE AS t
  FROM m GROUP BY feature, x, y)
SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM c GROUP BY 1""",
)
def mutual_information(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    features = ["o_orderpriority", "c_mktsegment", "c_nationkey"]
    return rounded(C.mutual_information(df, features, "o_orderstatus"))


@query(
    "mutual_information_binned",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
m AS (SELECT least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)::INT) AS x, l_returnflag AS y FROM lineitem, r),
c AS (
  SELECT x, y, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY x))::DOUBLE AS nx,
         (sum(count(*)) OVER (PARTITION BY y))::DOUBLE AS ny, (sum(count(*)) OVER ())::DOUBLE AS t FROM m GROUP BY x, y)
SELECT 'l_extendedprice' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM c""",
)
def mutual_information_binned(t):
    scores = C.mutual_information(t.lineitem, ["l_extendedprice"], "l_returnflag")
    return rounded(C.select_k_best(scores, 1))


SELECT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _cells(body: str) -> str:
    return " UNION ALL ".join(body.format(c=c) for c in SELECT_FEATURES)


@query(
    "chi2_scores",
    "WITH k AS (SELECT l_returnflag AS y, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t, "
    + ", ".join(f"sum({c}) AS s_{c}, sum(sum({c})) OVER () AS t_{c}" for c in SELECT_FEATURES)
    + " FROM lineitem GROUP BY 1) "
    + _cells("SELECT '{c}' AS feature, round(sum(pow(s_{c} - t_{c} * n / t, 2) / (t_{c} * n / t)), 4) AS score, "
             "round(exp(-sum(pow(s_{c} - t_{c} * n / t, 2) / (t_{c} * n / t)) / 2), 4) AS p_value FROM k"),
)
def chi2_scores(t):
    """With three classes there are two degrees of freedom, where the p-value is exp(-x / 2)."""
    return rounded(C.chi2_scores(t.lineitem, SELECT_FEATURES, "l_returnflag"), 4)


ANOVA_SQL = (
    "WITH k AS (SELECT l_returnflag AS y, count(*)::DOUBLE AS n, "
    + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) * count(*) AS q_{c}" for c in SELECT_FEATURES)
    + " FROM lineitem GROUP BY 1), w AS (SELECT sum(n) AS t, count(*) AS k, "
    + ", ".join(f"sum(n * m_{c}) / sum(n) AS g_{c}, sum(q_{c}) AS q_{c}" for c in SELECT_FEATURES)
    + " FROM k) "
    + _cells("SELECT '{c}' AS feature, round((SELECT sum(n * pow(m_{c} - g_{c}, 2)) FROM k, w) / (k - 1) / (q_{c} / (t - k)), 6) AS score FROM w")
)


@query("anova_scores", ANOVA_SQL)
def anova_scores(t):
    return rounded(C.anova_scores(t.lineitem, SELECT_FEATURES, "l_returnflag").drop("p_value"))


@query(
    "regression_scores",
    _cells(
        "SELECT '{c}' AS feature, round(pow(corr({c}, l_tax), 2) / (1 - pow(corr({c}, l_tax), 2)) * (count(*) - 2), 6) AS score FROM lineitem"
    ),
)
def regression_scores(t):
    return rounded(C.regression_scores(t.lineitem, SELECT_FEATURES, "l_tax").drop("p_value"))


@query(
    "variance_threshold",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS score FROM lineitem" for c in NUMBERS) + ") WHERE score > 0.01",
)
def variance_threshold(t):
    return rounded(C.variance_threshold(t.lineitem, NUMBERS, 0.01), 4)


@query(
    "select_percentile",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS score FROM lineitem" for c in NUMBERS) + ") ORDER BY score DESC LIMIT 2",
)
def select_percentile(t):
    return rounded(C.select_percentile(C.variances(t.lineitem, NUMBERS), 50), 4)


@query(
    "select_from_model",
    """WITH m AS (SELECT p_brand AS feature, avg(p_retailprice) AS importance_score FROM part GROUP BY 1)
SELECT feature, round(importance_score, 4) AS importance_score FROM m WHERE importance_score >= (SELECT avg(importance_score) FROM m)""",
)
def select_from_model(t):
    table = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance_score"))
    return rounded(C.select_from_model(table), 4)


@query("recursive_elimination")
def recursive_elimination(t):
    """Keep two of four features for the price, by the size of standardised linear weights."""
    from modelyard.operators.models import estimator

    features = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    scaled = S.apply_scaler(t.lineitem, S.fit_scaler(t.lineitem, features, "standard"))

    def weights(names: list[str]) -> dict[str, float]:
        rows = scaled.select(assemble(names).alias("features"), F.col("l_extendedprice").alias("label"))
        model = estimator("ridge", "regression").fit(rows)
        return {n: abs(float(w)) for n, w in zip(names, model.coefficients)}

    ranks = C.eliminate(features, weights, keep=2)
    return t.spark.createDataFrame(ranks, "feature string, rank int")


@query("outliers")
def outliers(t):
    df = t.part.select("p_partkey", assemble(["p_size", "p_retailprice"]).alias("features"))
    return O.flag_outliers(df, "features", "p_partkey").drop("features")


@query("train_test_split")
def train_test_split(t):
    train, test = L.train_test_split(t.orders, ["o_orderkey"])
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "stratified_split",
    """SELECT o_orderstatus, 'test' AS side, round(count(*) * 0.2)::BIGINT AS n FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, 'train', (count(*) - round(count(*) * 0.2))::BIGINT FROM orders GROUP BY 1""",
)
def stratified_split(t):
    """The SQL knows the sizes; which rows are drawn depends on the hash."""
    train, test = L.stratified_split(t.orders, "o_orderstatus", "o_orderkey")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("o_orderstatus", "side").agg(F.count("*").alias("n"))


@query(
    "block_folds",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1)
                      ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS fold FROM r""",
)
def block_folds(t):
    return L.block_folds(t.events.select("event_id"), "event_id", 7)


@query(
    "stratified_folds",
    """WITH laid AS (SELECT event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS pos FROM events),
sizes AS (SELECT event_type, pos % 5 AS i, count(*) AS n FROM laid GROUP BY ALL),
ends AS (SELECT event_type, i, sum(n) OVER (PARTITION BY event_type ORDER BY i) AS e FROM sizes),
ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
SELECT event_id, event_type, (SELECT count(*) FROM ends e WHERE e.event_type = k.event_type AND e.e < k.r)::INT AS fold FROM ranked k""",
)
def stratified_folds(t):
    return L.stratified_folds(t.events.select("event_id", "event_type"), "event_id", "event_type")


@query("hash_folds")
def hash_folds(t):
    folds = L.hash_folds(t.lineitem, ["l_orderkey", "l_linenumber"])
    return folds.groupBy("fold").agg(F.count("*").alias("n"))


@query(
    "balanced_weights",
    """SELECT doc_id, round((SELECT count(*)::DOUBLE / count(DISTINCT toxic) FROM labels) / count(*) OVER (PARTITION BY toxic), 6) AS weight
FROM labels""",
)
def balanced_weights(t):
    return rounded(L.balanced_weights(t.labels, "toxic").select("doc_id", "weight"))


@query(
    "prepared_features",
    """WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q, quantile_cont(l_tax, [0.25, 0.5, 0.75]) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - q[2]) / (q[3] - q[1]), 6) AS l_quantity, round((l_tax - x[2]) / (x[3] - x[1]), 6) AS l_tax,
       (l_returnflag = 'N')::INT::DOUBLE AS "l_returnflag_N", (l_returnflag = 'R')::INT::DOUBLE AS "l_returnflag_R",
       CASE l_linestatus WHEN 'F' THEN 0.0 ELSE 1.0 END::DOUBLE AS label
FROM lineitem, s""",
)
def prepared_features(t):
    """The whole preparation in one go, with the vector opened up under its feature names."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    keys = ["l_orderkey", "l_linenumber"]
    fitted = P.fit_preparation(df, "l_linestatus", "classification", ignore=keys)
    rows = fitted.transform(df, keep=keys)
    x = vector_to_array("features")
    return rounded(rows.select(*keys, *[x[i].alias(n) for i, n in enumerate(fitted.feature_names)], "label"))
