"""Model queries. Fitted models differ between engines, so most are checked for rows only and tested on fixtures."""

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import as_vector, assemble
from modelyard.operators import explain as X
from modelyard.operators import search as S
from modelyard.operators.comparison import side_by_side
from modelyard.operators.models import estimator
from modelyard.operators.neighbours import nearest
from modelyard.operators.partitioning import agglomerative, dbscan, single_linkage
from modelyard.operators.spectrum import spectral
from modelyard.operators.split import train_test_split
from modelyard.plans.catalog import Tables, query, rounded
from modelyard.plans.pipelines import evaluate
from modelyard.session import balanced, shared_folder

INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scratch(t: Tables, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{shared_folder(t.spark)}/modelyard/{name}-{uuid.uuid4().hex}"


def line_key():
    """A row key of `lineitem`: order and line number alone are not unique there."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return F.xxhash64(*columns).alias("key")


def line_classes(t: Tables) -> DataFrame:
    """Whether a line was returned, from its numbers."""
    return t.lineitem.select(
        line_key(),
        assemble(INPUTS).alias("features"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )


def line_prices(t: Tables) -> DataFrame:
    return t.lineitem.select(
        line_key(),
        assemble(["l_quantity", "l_discount", "l_tax"]).alias("features"),
        F.col("l_extendedprice").alias("label"),
    )


def vectors(t: Tables) -> DataFrame:
    df = t.embeddings
    return df.select(F.col("vec_id").alias("key"), as_vector(df, "embedding").alias("features"), F.col("label").cast("double").alias("label"))


@query(
    "ols_single",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def ols_single(t):
    rows = t.lineitem.select(assemble(["l_quantity"]).alias("features"), F.col("l_extendedprice").alias("label"))
    model = estimator("linear_regression", "regression").fit(rows)
    found = [(round(float(model.coefficients[0]), 4), round(model.intercept, 4), round(model.summary.r2, 6))]
    return t.spark.createDataFrame(found, "slope double, intercept double, r2 double")


ONE_FEATURE_SQL = """
WITH m AS (
  SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx,
         covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
"""


def _one_feature(name: str, slope: str, **params) -> None:
    """A penalised fit on one feature has a closed form."""

    @query(f"{name}_single", ONE_FEATURE_SQL + f"SELECT round({slope}, 4) AS slope, round(my - {slope} * mx, 4) AS intercept FROM m")
    def fit(t):
        rows = t.lineitem.select(assemble(["l_quantity"]).alias("features"), F.col("l_extendedprice").alias("label"))
        model = estimator(name, "regression", **params).fit(rows)
        found = [(float(model.coefficients[0]), float(model.intercept))]
        return rounded(t.spark.createDataFrame(found, "slope double, intercept double"), 4)


_one_feature("ridge", "(c / (vx + 100000.0 / n))", alpha=100000.0)
_one_feature("lasso", "(sign(c) * greatest(0, abs(c) - 50.0) / vx)", alpha=50.0)
_one_feature("elastic_net", "(sign(c) * greatest(0, abs(c) - 5.0) / (vx + 5.0))", alpha=10.0, l1_ratio=0.5)


def line_flags(t: Tables) -> DataFrame:
    """Three return flags from the quantity and a discount on the same scale."""
    code = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    cells = F.array(F.col("l_quantity"), F.col("l_discount") * 100)
    return t.lineitem.select(line_key(), "l_orderkey", "l_quantity", "l_discount", array_to_vector(cells).alias("features"), code.alias("label"))


FLAG_SQL = """
WITH d AS (
  SELECT l_orderkey, l_quantity, l_discount, l_quantity AS x, l_discount * 100 AS z,
         CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END::DOUBLE AS y FROM lineitem),
k AS (
  SELECT y, count(*)::DOUBLE AS n, (sum(count(*)) OVER ())::DOUBLE AS total, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS vx, var_pop(z) AS vz,
         covar_pop(x, z) AS cxz, sum(x) AS sx, sum(z) AS sz FROM d GROUP BY 1),
"""

PICK_SQL = """
SELECT l_quantity, l_discount, arg_max(y, s) AS prediction, count(*) // 3 AS n FROM s GROUP BY l_quantity, l_discount"""


def _predictions(model, rows: DataFrame) -> DataFrame:
    """The decision for every pair of inputs, with its rows."""
    return model.transform(rows).groupBy("l_quantity", "l_discount", "prediction").agg(F.count("*").alias("n"))


@query(
    "gaussian_nb_predictions",
    FLAG_SQL
    + """e AS (SELECT 1e-9 * greatest(var_pop(x), var_pop(z)) AS e FROM d),
s AS (
  SELECT l_quantity, l_discount, k.y, ln(n / total) - 0.5 * (ln(2 * pi() * (vx + e)) + pow(x - mx, 2) / (vx + e) + ln(2 * pi() * (vz + e)) + pow(z - mz, 2) / (vz + e)) AS s
  FROM d, k, e)"""
    + PICK_SQL,
)
def gaussian_nb_predictions(t):
    rows = line_flags(t)
    return _predictions(estimator("gaussian_nb", "classification").fit(rows), rows)


@query(
    "multinomial_nb_predictions",
    FLAG_SQL
    + """s AS (
  SELECT l_quantity, l_discount, k.y, ln(n / total) + x * ln((sx + 1) / (sx + sz + 2)) + z * ln((sz + 1) / (sx + sz + 2)) AS s FROM d, k)"""
    + PICK_SQL,
)
def multinomial_nb_predictions(t):
    rows = line_flags(t)
    return _predictions(estimator("multinomial_nb", "classification").fit(rows), rows)


@query(
    "discriminant_predictions",
    FLAG_SQL
    + """w AS (SELECT sum(n * vx) / (sum(n) - count(*)) AS a, sum(n * cxz) / (sum(n) - count(*)) AS b, sum(n * vz) / (sum(n) - count(*)) AS c FROM k),
g AS (SELECT y, n, total, mx, mz, (c * mx - b * mz) / (a * c - b * b) AS wx, (a * mz - b * mx) / (a * c - b * b) AS wz FROM k, w),
s AS (SELECT l_quantity, l_discount, g.y, ln(n / total) + wx * x + wz * z - 0.5 * (wx * mx + wz * mz) AS s FROM d, g)"""
    + PICK_SQL,
)
def discriminant_predictions(t):
    rows = line_flags(t)
    return _predictions(estimator("lda", "classification").fit(rows), rows)


@query(
    "discriminant_probabilities",
    FLAG_SQL
    + """w AS (SELECT sum(n * vx) / (sum(n) - count(*)) AS a, sum(n * cxz) / (sum(n) - count(*)) AS b, sum(n * vz) / (sum(n) - count(*)) AS c FROM k),
g AS (SELECT y, n, total, mx, mz, (c * mx - b * mz) / (a * c - b * b) AS wx, (a * mz - b * mx) / (a * c - b * b) AS wz FROM k, w),
s AS (SELECT l_quantity, l_discount, g.y, exp(ln(n / total) + wx * x + wz * z - 0.5 * (wx * mx + wz * mz)) AS s FROM (SELECT DISTINCT l_quantity, l_discount, x, z FROM d), g)
SELECT l_quantity, l_discount, round(max(s) FILTER (y = 0) / sum(s), 6) AS p0, round(max(s) FILTER (y = 1) / sum(s), 6) AS p1,
       round(max(s) FILTER (y = 2) / sum(s), 6) AS p2 FROM s GROUP BY ALL""",
)
def discriminant_probabilities(t):
    rows = line_flags(t)
    scored = estimator("lda", "classification").fit(rows).transform(rows)
    x = vector_to_array("probability")
    cells = scored.groupBy("l_quantity", "l_discount").agg(*[F.max(x[i]).alias(f"p{i}") for i in range(3)])
    return rounded(cells)


MOMENTS_SQL = """
WITH d AS (SELECT l_quantity AS x, l_discount * 100 AS z FROM lineitem),
m AS (SELECT {a} AS a, {b} AS b, {c} AS c FROM d),
v AS (SELECT (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m)
"""


@query(
    "pca_spectrum",
    MOMENTS_SQL.format(a="var_samp(x)", b="covar_samp(x, z)", c="var_samp(z)")
    + "SELECT unnest([1, 2]) AS component, unnest([round(l1, 4), round(l2, 4)]) AS variance, unnest([round(l1 / (l1 + l2), 6), round(l2 / (l1 + l2), 6)]) AS ratio FROM v",
)
def pca_spectrum(t):
    model = estimator("pca", "dimensionality_reduction").fit(line_flags(t))
    found = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(model.explained_variance, model.explained_ratio))]
    table = t.spark.createDataFrame(found, "component int, variance double, ratio double")
    return table.select("component", F.round("variance", 4).alias("variance"), F.round("ratio", 6).alias("ratio"))


@query(
    "svd_spectrum",
    MOMENTS_SQL.format(a="sum(x * x)", b="sum(x * z)", c="sum(z * z)")
    + "SELECT unnest([1, 2]) AS component, unnest([round(sqrt(l1), 4), round(sqrt(l2), 4)]) AS singular_value FROM v",
)
def svd_spectrum(t):
    model = estimator("truncated_svd", "dimensionality_reduction").fit(line_flags(t))
    found = [(i + 1, float(v)) for i, v in enumerate(model.singular_values)]
    return rounded(t.spark.createDataFrame(found, "component int, singular_value double"), 4)


# Small settings: the point of the queries is the whole table, not the best model.
SMALL = {
    "random_forest": {"n_estimators": 10, "max_depth": 5},
    "extra_trees": {"n_estimators": 10, "max_depth": 5},
    "gradient_boosting": {"n_estimators": 5},
    "hist_gradient_boosting": {"n_estimators": 5},
    "xgboost": {"n_estimators": 5, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.8},
    "lightgbm": {"n_estimators": 5, "num_leaves": 20},
    "catboost": {"iterations": 5, "depth": 4},
    "ada_boost": {"n_estimators": 5},
    "decision_tree": {"max_depth": 5},
    "mlp": {"hidden": [8], "max_iter": 20},
    "logistic_regression": {"max_iter": 50},
    "linear_svc": {"max_iter": 10},
    "sgd": {"max_iter": 10},
}


GROWTH_DEPTH = 2


def _extra_trees_sql(trees: int = 5, depth: int = GROWTH_DEPTH, seed: int = 42) -> str:
    """The growth of extremely randomised trees, level by level: cuts are drawn by md5, the best gain of Gini impurity wins."""
    share = lambda what: f"CAST('0x' || substr(md5('{seed}:{what}:' || tree || ':' || path || ':' || f), 1, 13) AS BIGINT) / 4503599627370496.0"
    gini = "({n} - ({p} * {p} + ({n} - {p}) * ({n} - {p})) / {n})"
    steps = [
        f"""a0 AS (SELECT tree, 1 AS path, x, y FROM (SELECT unnest(range({trees})) AS tree),
          (SELECT [l_quantity, l_extendedprice, l_discount, l_tax] AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem))"""
    ]
    for d in range(depth):
        steps.append(f"""
        c{d} AS (SELECT tree, path, f, low, high, least(low + {share("cut")} * (high - low), high - 1e-12) AS cut FROM (
          SELECT tree, path, f, min(x[f + 1]) AS low, max(x[f + 1]) AS high FROM a{d}, (SELECT unnest(range(4)) AS f) GROUP BY ALL) r
          QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY {share("feature")}, f) <= 2),
        g{d} AS (SELECT c.tree, c.path, f, cut, count(*)::DOUBLE AS n, sum(y) AS p, count(*) FILTER (x[f + 1] <= cut)::DOUBLE AS ln, coalesce(sum(y) FILTER (x[f + 1] <= cut), 0) AS lp
          FROM a{d} a JOIN c{d} c ON a.tree = c.tree AND a.path = c.path WHERE low < high GROUP BY ALL),
        b{d} AS (SELECT tree, path, f, cut FROM g{d} WHERE p > 0 AND p < n AND ln > 0 AND ln < n
          QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY {gini.format(n="n", p="p")} - {gini.format(n="ln", p="lp")} - {gini.format(n="(n - ln)", p="(p - lp)")} DESC, f) = 1),
        a{d + 1} AS (SELECT a.tree, 2 * a.path + CASE WHEN x[f + 1] > cut THEN 1 ELSE 0 END AS path, x, y FROM a{d} a JOIN b{d} b ON a.tree = b.tree AND a.path = b.path)""")
    parts = [
        f"SELECT a.tree, a.path, coalesce(any_value(f), -1) AS feature, coalesce(any_value(cut), 0.0) AS cut, count(*)::DOUBLE AS n, sum(y) AS positives "
        f"FROM a{d} a LEFT JOIN b{d} b ON a.tree = b.tree AND a.path = b.path GROUP BY a.tree, a.path"
        for d in range(depth)
    ]
    parts.append(f"SELECT tree, path, -1, 0.0, count(*)::DOUBLE, sum(y) FROM a{depth} GROUP BY tree, path")
    return "WITH " + ",".join(steps) + "SELECT tree::INTEGER AS tree, path::BIGINT AS path, feature::INTEGER AS feature, round(cut, 6)::DOUBLE AS cut, n, positives FROM (" + " UNION ALL ".join(parts) + ")"


@query("extra_trees_nodes", _extra_trees_sql())
def extra_trees_nodes(t):
    """Every node of a small forest of extremely randomised trees: split, rows and returned lines."""
    forest = estimator("extra_trees", "classification", n_estimators=5, max_depth=GROWTH_DEPTH).fit(line_classes(t))
    n, positives = F.aggregate("sums", F.lit(0.0), lambda a, v: a + v), F.get("sums", 1)
    return forest.nodes(t.spark).select("tree", "path", "feature", F.round("threshold", 6).alias("cut"), n.alias("n"), positives.alias("positives"))


def _boosting_sql(style: str, l2: float, rate: float, least_rows: int, depth: int = GROWTH_DEPTH) -> str:
    """The first tree of second-order boosting on squares: every distinct value is a cut, gains come from sums of gradients."""
    part = lambda g, h: f"({g}) * ({g}) / (({h}) + {l2})"
    steps = [
        """a0 AS (SELECT 1 AS path, x, m - y AS g FROM (SELECT [l_quantity, l_discount, l_tax] AS x, l_extendedprice AS y FROM lineitem),
          (SELECT avg(l_extendedprice) AS m FROM lineitem))"""
    ]
    for d in range(depth):
        group = "" if style == "level" else "PARTITION BY path"
        summed = "sum(gain)" if style == "level" else "gain"
        steps.append(f"""
        h{d} AS (SELECT path, f, x[f + 1] AS cut, count(*)::DOUBLE AS n, sum(g) AS g FROM a{d}, (SELECT unnest(range(3)) AS f) GROUP BY ALL),
        s{d} AS (SELECT path, f, cut, sum(n) OVER u AS ln, sum(g) OVER u AS lg, sum(n) OVER w AS n, sum(g) OVER w AS g FROM h{d}
          WINDOW w AS (PARTITION BY path, f), u AS (PARTITION BY path, f ORDER BY cut)),
        j{d} AS (SELECT path, f, cut, ({part("lg", "ln")} + {part("g - lg", "n - ln")} - {part("g", "n")}) / 2 AS gain FROM s{d} WHERE least(ln, n - ln) >= {least_rows}),
        b{d} AS (SELECT * FROM (SELECT {"" if style == "level" else "path,"} f, cut, {summed} AS gain FROM j{d} {"GROUP BY f, cut" if style == "level" else ""})
          WHERE gain > 0 QUALIFY row_number() OVER ({group} ORDER BY gain DESC, f, cut) = 1),
        a{d + 1} AS (SELECT 2 * a.path + CASE WHEN x[f + 1] > cut THEN 1 ELSE 0 END AS path, x, g FROM a{d} a JOIN b{d} b ON {"true" if style == "level" else "a.path = b.path"})""")
    leaf = f"round(-{rate} * sum(g) / (count(*) + {l2}), 4) AS value, count(*) AS n"
    return "WITH " + ",".join(steps) + f" SELECT path::BIGINT AS path, {leaf} FROM a{depth} GROUP BY path"


def _first_tree(name: str, **options):
    def leaves(t):
        rows = line_prices(t)
        model = estimator(name, "regression", n_estimators=1, **options).fit(rows)
        placed = model.leaf_rows(rows, 0).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        nodes = model.nodes(t.spark).where("feature < 0").withColumn("leaf", F.lit(None).cast("int"))
        numbers = t.spark.createDataFrame(list(enumerate(model.rounds()[0][0].path)), "leaf int, path long")
        return rounded(placed.join(F.broadcast(numbers), "leaf").join(F.broadcast(nodes.drop("leaf")), "path").select("path", "value", "n"), 4)

    return leaves


query("xgboost_leaves", _boosting_sql("depth", 1.0, 0.3, 1))(_first_tree("xgboost", max_depth=GROWTH_DEPTH))
query("catboost_leaves", _boosting_sql("level", 3.0, 0.03, 1))(_first_tree("catboost", depth=GROWTH_DEPTH, learning_rate=0.03))
# Four leaves at most two deep: always the leaf that gains most, which here is the same tree.
query("lightgbm_leaves", _boosting_sql("depth", 0.0, 0.1, 20))(_first_tree("lightgbm", num_leaves=4, max_depth=GROWTH_DEPTH))


def _register_training(name: str, task: str, source) -> None:
    @query(f"train_{task}_{name}")
    def train(t):
        train_rows, test_rows = train_test_split(source(t), ["key"])
        train_rows = balanced(train_rows).persist()
        try:
            model = estimator(name, task, **SMALL.get(name, {})).fit(train_rows)
        finally:
            train_rows.unpersist()
        return evaluate(model, test_rows, task)


for _name in (
    "logistic_regression random_forest gradient_boosting hist_gradient_boosting extra_trees ada_boost linear_svc decision_tree "
    "mlp gaussian_nb multinomial_nb lda ridge sgd xgboost lightgbm catboost"
).split():
    _register_training(_name, "classification", line_classes)
for _name in (
    "linear_regression ridge lasso elastic_net random_forest gradient_boosting hist_gradient_boosting extra_trees ada_boost "
    "decision_tree sgd xgboost lightgbm catboost"
).split():
    _register_training(_name, "regression", line_prices)


NEAR_SQL = """
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS key, b.vec_id AS donor, b.label, array_distance(a.x, b.x) AS gap FROM p a, p b WHERE a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, donor) AS r FROM pairs) WHERE r <= 5)
"""


@query("nearest_neighbours", NEAR_SQL + "SELECT key, donor, round(gap, 6) AS gap FROM near")
def nearest_neighbours(t):
    rows = vectors(t)
    return rounded(nearest(rows, rows, 5, skip_self=True).drop("label"))


SELF_NEAR_SQL = NEAR_SQL.replace(" WHERE a.vec_id <> b.vec_id", "")


@query(
    "knn_classify",
    SELF_NEAR_SQL
    + """, votes AS (SELECT key, label, count(*) AS n FROM near GROUP BY ALL)
SELECT key, arg_max(label, n * 1000 - label)::DOUBLE AS prediction FROM votes GROUP BY 1""",
)
def knn_classify(t):
    rows = vectors(t)
    return estimator("knn", "classification").fit(rows).transform(rows).select("key", "prediction")


@query("knn_regress", SELF_NEAR_SQL + "SELECT key, round(avg(label), 6) AS prediction FROM near GROUP BY 1")
def knn_regress(t):
    rows = vectors(t)
    return rounded(estimator("knn", "regression").fit(rows).transform(rows).select("key", "prediction"))


def _clusters(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).groupBy(F.col("prediction").cast("int").alias("cluster")).agg(F.count("*").alias("n"))


@query("kmeans")
def kmeans(t):
    rows = vectors(t)
    return _clusters(estimator("kmeans", "clustering", n_clusters=10).fit(rows), rows)


@query("bisecting_kmeans")
def bisecting_kmeans(t):
    rows = vectors(t)
    return _clusters(estimator("hierarchical", "clustering", n_clusters=10).fit(rows), rows)


@query("minibatch_kmeans")
def minibatch_kmeans(t):
    rows = vectors(t)
    return _clusters(estimator("minibatch_kmeans", "clustering", n_clusters=10, batch_rows=256, rounds=5).fit(rows), rows)


# The radius reaches the near neighbours of most vectors.
EPS = 1.12


@query(
    "dbscan",
    f"""WITH RECURSIVE p AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
close AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE array_distance(a.x, b.x) <= {EPS}),
core AS (SELECT a FROM close GROUP BY a HAVING count(*) >= 5),
edges AS (SELECT c.a, c.b FROM close c JOIN core x ON c.a = x.a JOIN core y ON c.b = y.a),
reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a, min(b) AS cluster FROM reach GROUP BY 1),
border AS (SELECT c.a, min(c.b) AS near FROM close c JOIN core y ON c.b = y.a WHERE c.a NOT IN (SELECT a FROM core) GROUP BY 1),
found AS (SELECT * FROM named UNION ALL SELECT border.a, named.cluster FROM border JOIN named ON border.near = named.a)
SELECT vec_id, coalesce(cluster, -1)::BIGINT AS cluster FROM p LEFT JOIN found ON vec_id = a""",
)
def dbscan_clusters(t):
    return dbscan(t.embeddings.select("vec_id", as_vector(t.embeddings, "embedding").alias("features")), "vec_id", EPS)


TREE_SQL = """
WITH RECURSIVE p AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
prim(step, v, x, gap, a, b) AS (
  SELECT 0, p.vec_id, p.x, array_distance(p.x, r.x), least(p.vec_id, r.vec_id), greatest(p.vec_id, r.vec_id)
  FROM p, (SELECT * FROM p ORDER BY vec_id LIMIT 1) r WHERE p.vec_id <> r.vec_id
  UNION ALL
  SELECT step + 1, v, x, CASE WHEN nearer THEN now ELSE gap END, CASE WHEN nearer THEN least(u, v) ELSE a END, CASE WHEN nearer THEN greatest(u, v) ELSE b END
  FROM (
    SELECT *, (now, least(u, v), greatest(u, v)) < (gap, a, b) AS nearer FROM (
      SELECT *, array_distance(x, ux) AS now FROM (
        SELECT *, first_value(v) OVER o AS u, first_value(x) OVER o AS ux FROM prim WINDOW o AS (ORDER BY gap, a, b)))
  ) WHERE v <> u
),
tree AS (SELECT gap, a, b FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY gap, a, b) AS r FROM prim) WHERE r = 1)
"""


@query("single_linkage", TREE_SQL + "SELECT round(gap, 6) AS gap, a, b FROM tree")
def single_linkage_tree(t):
    return rounded(single_linkage(t.embeddings.select("vec_id", as_vector(t.embeddings, "embedding").alias("features")), "vec_id"))


@query(
    "agglomerative",
    TREE_SQL
    + """, kept AS (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, a DESC, b DESC) AS r FROM tree) WHERE r > 9),
links AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach(a, b) AS (SELECT vec_id, vec_id FROM p UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY 1""",
)
def agglomerative_clusters(t):
    return agglomerative(t.embeddings.select("vec_id", as_vector(t.embeddings, "embedding").alias("features")), "vec_id", 10)


@query("spectral")
def spectral_clusters(t):
    return spectral(t.embeddings.select("vec_id", as_vector(t.embeddings, "embedding").alias("features")), "vec_id", 10)


def _reduced(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    column = "reduced" if "reduced" in out.columns else "topicDistribution"
    return out.select("key", vector_to_array(column).alias("reduced"))


@query("pca")
def pca(t):
    rows = vectors(t)
    return _reduced(estimator("pca", "dimensionality_reduction", n_components=8).fit(rows), rows)


@query(
    "pca_variance",
    """WITH c AS (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT dim, var_samp(x) AS v FROM c GROUP BY 1)
SELECT round(sum(v), 6) AS total_variance, 1.0::DOUBLE AS ratio FROM v""",
)
def pca_variance(t):
    """All components together keep the whole variance."""
    model = estimator("pca", "dimensionality_reduction").fit(vectors(t))
    total, ratio = float(sum(model.explained_variance)), float(sum(model.explained_ratio))
    return rounded(t.spark.createDataFrame([(total, ratio)], "total_variance double, ratio double"))


@query("truncated_svd")
def truncated_svd(t):
    rows = vectors(t)
    return _reduced(estimator("truncated_svd", "dimensionality_reduction", n_components=8).fit(rows), rows)


@query("fast_ica")
def fast_ica(t):
    rows = line_classes(t)
    return _reduced(estimator("fast_ica", "dimensionality_reduction", n_components=3, max_iter=10).fit(rows), rows)


@query("nmf")
def nmf(t):
    rows = line_classes(t)
    return _reduced(estimator("nmf", "dimensionality_reduction", n_components=2, max_iter=5).fit(rows), rows)


@query("lda_topics")
def lda_topics(t):
    """Users as documents, their event types as words."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = t.events.groupBy(F.col("user_id").alias("key")).agg(
        *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds]
    )
    rows = counts.select("key", assemble(kinds).alias("features"))
    return _reduced(estimator("lda", "dimensionality_reduction", n_components=3).fit(rows), rows)


@query("search_best")
def search_best(t):
    """Four random trials with two folds; one row per trial."""
    found = S.search(
        line_classes(t),
        "classification",
        ["key"],
        n_trials=4,
        folds=2,
        names=["gaussian_nb", "lda", "ridge", "decision_tree"],
    )
    return S.trial_table(t.spark, found["trials"]).drop("started")


STUDY_SQL = "WITH trials AS (SELECT user_id, event_id, ts, round(value / 500, 1) AS value FROM events)\n"


def studies(t: Tables) -> DataFrame:
    """Every user is a study, every event a trial."""
    return t.events.select("user_id", "event_id", "ts", F.round(F.col("value") / 500, 1).alias("value"))


@query(
    "best_so_far",
    STUDY_SQL + "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM trials",
)
def best_so_far(t):
    return S.best_so_far(studies(t), ["user_id"], "event_id").select("user_id", "event_id", "best")


@query(
    "early_stop",
    STUDY_SQL
    + """SELECT user_id, event_id, count(*) OVER w = 5 AND max(value) OVER w - min(value) OVER w < 0.001 AS settled FROM trials
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def early_stop(t):
    return S.settled_at(studies(t), ["user_id"], "event_id", patience=5).select("user_id", "event_id", "settled")


@query("feature_importance")
def feature_importance(t):
    model = estimator("random_forest", "classification", **SMALL["random_forest"]).fit(line_classes(t))
    return X.feature_importance(t.spark, model, INPUTS)


WEIGHTS = [1000.0, 20000.0, -5000.0]


@query(
    "linear_shapley",
    """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
       unnest([round(1000.0 * (l_quantity - q), 4), round(20000.0 * (l_discount - d), 4), round(-5000.0 * (l_tax - x), 4)]) AS value
FROM lineitem, m""",
)
def linear_shapley(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("key"), assemble(names).alias("features"))
    return rounded(X.linear_shapley(rows, "key", WEIGHTS, names).select("key.*", "feature", "value"), 4)


@query("sampled_shapley")
def sampled_shapley(t):
    rows = line_classes(t)
    model = estimator("decision_tree", "classification", max_depth=4).fit(rows)
    return X.sampled_shapley(rows, "key", model, INPUTS, permutations=4)


@query("learning_curve")
def learning_curve(t):
    return X.learning_curve(
        line_classes(t),
        ["key"],
        lambda: estimator("lda", "classification"),
        lambda model, df: S.score(model, df, "classification"),
        sizes=(0.1, 1.0),
        folds=2,
    )


@query("compare_fitted_models")
def compare_fitted_models(t):
    """Two models on the same held-out rows, side by side."""
    train_rows, test_rows = train_test_split(line_classes(t), ["key"])
    out = None
    for name in ("lda", "gaussian_nb"):
        model = estimator(name, "classification").fit(train_rows)
        part = evaluate(model, test_rows, "classification").withColumn("model_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return side_by_side(out, ["accuracy", "f1_macro", "roc_auc"])


@query("champion_challenger")
def champion_challenger(t):
    """Train on lines shipped early, then retrain on the late ones if that is better."""
    from modelyard.plans.pipelines import retrain_if_better, train
    from modelyard.sources.store import Store

    store = Store(t.spark, scratch(t, "champion"))
    rows = t.lineitem.select(
        line_key(), "l_quantity", "l_discount", "l_linestatus", "l_extendedprice", "l_shipdate"
    )
    cut = F.lit("1997-01-01").cast("timestamp")
    options = {"n_trials": 1, "folds": 2, "names": ["linear_regression"]}
    now = F.lit("2024-01-01").cast("timestamp")
    train(store, rows.where(F.col("l_shipdate") < cut), "l_extendedprice", "regression", "price", ["key"], now, **options)
    later = F.lit("2024-01-02").cast("timestamp")
    retrain_if_better(store, rows.where(F.col("l_shipdate") >= cut), "price", ["key"], later, **options)
    return store.read("model_updates").drop("id", "update_time")


@query("predict_pipeline")
def predict_pipeline(t):
    """Train, store, load and score: every line gets a formatted prediction, which is also logged."""
    from modelyard.plans.pipelines import predict, train
    from modelyard.sources.store import Store

    store = Store(t.spark, scratch(t, "predict"))
    rows = t.lineitem.select(
        line_key(), "l_quantity", "l_tax", "l_linestatus", "l_returnflag"
    )
    now = F.lit("2024-01-01").cast("timestamp")
    options = {"n_trials": 1, "folds": 2, "names": ["gaussian_nb"]}
    train(store, rows, "l_returnflag", "classification", "flag", ["key"], now, **options)
    out = predict(store, rows.drop("l_returnflag"), "flag", now, keep=["key"])
    return out.withColumn("probabilities", F.to_json("probabilities"))
