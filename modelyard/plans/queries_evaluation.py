"""Evaluation queries. Predictions are fixed expressions over the given columns, so that SQL can repeat them."""

from pyspark.sql import DataFrame, functions as F

from modelyard.functions.vectors import as_array
from modelyard.operators import classification as C
from modelyard.operators import clustering as K
from modelyard.operators import regression as R
from modelyard.plans.catalog import Tables, query, rounded

# The long documents are called toxic when they are long; the score is a length share with many ties.
LABELLED_SQL = """
WITH scored AS (
  SELECT d.doc_id, l.toxic AS label, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction,
         least(1.0, floor(d.n_chars / 100) / 100.0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

# Shipping class from quantity against the true return flag: three classes over the whole table.
FLAGS_SQL = """
WITH scored AS (
  SELECT l_returnflag AS label,
         CASE WHEN l_quantity <= 17 THEN 'A' WHEN l_quantity <= 34 THEN 'N' ELSE 'R' END AS prediction
  FROM lineitem)
"""

FIT_SQL = """
WITH e AS (
  SELECT l_extendedprice AS y, l_extendedprice - (1000.0 * l_quantity + 20000.0 * l_discount + 28000.0) AS e
  FROM lineitem)
"""


def labelled(t: Tables) -> DataFrame:
    d, label = t.documents, t.labels
    return d.join(label, "doc_id").select(
        "doc_id",
        F.col("toxic").alias("label"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"),
        F.least(F.lit(1.0), F.floor(F.col("n_chars") / 100) / F.lit(100.0)).alias("score"),
    )


def flags(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_returnflag").alias("label"),
        F.when(quantity <= 17, "A").when(quantity <= 34, "N").otherwise("R").alias("prediction"),
    )


def fitted(t: Tables) -> DataFrame:
    price = F.lit(1000.0) * F.col("l_quantity") + F.lit(20000.0) * F.col("l_discount") + F.lit(28000.0)
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), price.alias("p"))


@query("accuracy", LABELLED_SQL + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored")
def accuracy(t):
    return rounded(C.accuracy(labelled(t), "label", "prediction"))


CELLS_SQL = """, names AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
cells AS (
  SELECT a.c AS label, b.c AS prediction,
         (SELECT count(*) FROM scored s WHERE s.label = a.c AND s.prediction = b.c)::BIGINT AS n
  FROM names a, names b)
"""


@query("confusion_matrix", FLAGS_SQL + CELLS_SQL + "SELECT * FROM cells")
def confusion_matrix(t):
    return C.confusion_matrix(flags(t), "label", "prediction")


@query(
    "confusion_matrix_normalised",
    LABELLED_SQL
    + CELLS_SQL
    + "SELECT label, prediction, n, round(n / sum(n) OVER (PARTITION BY label), 6)::DOUBLE AS share FROM cells",
)
def confusion_matrix_normalised(t):
    return rounded(C.confusion_matrix(labelled(t), "label", "prediction", normalise=True))


CLASS_SQL = """, names AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
classes AS (
  SELECT c, count(*) FILTER (label = c AND prediction = c)::DOUBLE AS hit,
         count(*) FILTER (label = c)::DOUBLE AS support, count(*) FILTER (prediction = c)::DOUBLE AS chosen
  FROM scored, names GROUP BY c),
m AS (
  SELECT c, hit, support, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END AS p,
         CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r,
         CASE WHEN chosen + support > 0 THEN 2 * hit / (chosen + support) ELSE 0 END AS f
  FROM classes)
"""

AVERAGES_SQL = """, a AS (
  SELECT sum(hit) / sum(support) AS acc, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm, sum(p * support) / sum(support) AS pw,
         sum(r * support) / sum(support) AS rw, sum(f * support) / sum(support) AS fw, sum(support) AS n
  FROM m)
"""


@query(
    "classification_metrics",
    FLAGS_SQL
    + CLASS_SQL
    + AVERAGES_SQL
    + """SELECT metric, round(value, 6) AS value FROM (
  SELECT unnest(['accuracy', 'precision_macro', 'recall_macro', 'f1_macro', 'precision_weighted', 'recall_weighted',
                 'f1_weighted']) AS metric, unnest([acc, pm, rm, fm, pw, rw, fw]) AS value FROM a)""",
)
def classification_metrics(t):
    return rounded(C.classification_metrics(flags(t), "label", "prediction"))


@query(
    "classification_report",
    FLAGS_SQL
    + CLASS_SQL
    + AVERAGES_SQL
    + """SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM m
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n::BIGINT FROM a
UNION ALL SELECT 'macro avg', round(pm, 6), round(rm, 6), round(fm, 6), n::BIGINT FROM a
UNION ALL SELECT 'weighted avg', round(pw, 6), round(rw, 6), round(fw, 6), n::BIGINT FROM a""",
)
def classification_report(t):
    return rounded(C.classification_report(flags(t), "label", "prediction"))


STEPS_SQL = """, counts AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
steps AS (
  SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
         sum(pos) OVER () AS np, sum(neg) OVER () AS nn, lead(pos) OVER (ORDER BY score DESC) AS pos2,
         lead(neg) OVER (ORDER BY score DESC) AS neg2
  FROM counts)
"""


@query(
    "roc_auc",
    LABELLED_SQL
    + STEPS_SQL
    + "SELECT round(sum(pos::DOUBLE * (nn - fp + neg / 2.0)) / (max(np)::DOUBLE * max(nn)), 6) AS roc_auc FROM steps",
)
def roc_auc(t):
    return rounded(C.roc_auc(labelled(t), F.col("label") == 1, F.col("score")))


@query(
    "roc_auc_large",
    """WITH counts AS (
  SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
         count(*) FILTER (l_returnflag <> 'R') AS neg, l_linestatus FROM lineitem GROUP BY ALL),
steps AS (SELECT *, sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score) AS below FROM counts)
SELECT l_linestatus, round(sum(pos::DOUBLE * (below - neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc
FROM steps GROUP BY 1""",
)
def roc_auc_large(t):
    return rounded(
        C.roc_auc(t.lineitem, F.col("l_returnflag") == "R", F.col("l_extendedprice"), ["l_linestatus"])
    )


@query(
    "average_precision",
    LABELLED_SQL
    + STEPS_SQL
    + "SELECT round(sum(pos::DOUBLE * tp / (tp + fp)) / max(np), 6) AS average_precision FROM steps",
)
def average_precision(t):
    return rounded(C.average_precision(labelled(t), F.col("label") == 1, F.col("score")))


@query(
    "roc_curve",
    LABELLED_SQL
    + STEPS_SQL
    + """SELECT score AS threshold, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / np::DOUBLE, 6) AS tpr FROM steps
WHERE pos2 IS NULL OR pos2 <> pos OR neg2 <> neg OR (tp = pos AND fp = neg)
UNION ALL SELECT NULL, 0.0, 0.0""",
)
def roc_curve(t):
    return rounded(C.roc_curve(labelled(t), F.col("label") == 1, F.col("score")))


@query(
    "pr_curve",
    LABELLED_SQL
    + STEPS_SQL
    + """SELECT score AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / np::DOUBLE, 6) AS recall FROM steps
UNION ALL SELECT NULL, 1.0, 0.0""",
)
def pr_curve(t):
    return rounded(C.pr_curve(labelled(t), F.col("label") == 1, F.col("score")))


def _class_scores(t: Tables) -> tuple[DataFrame, dict]:
    """Ten classes; the score of class i is component i of the vector."""
    df = t.embeddings
    x = as_array(df, "embedding")
    return df.select("label", x.alias("x")), {i: F.element_at("x", i + 1) for i in range(10)}


VECTOR_CLASSES_SQL = """
WITH melted AS (
  SELECT label, c.i AS class, embedding[c.i + 1]::DOUBLE AS score FROM embeddings, (SELECT range AS i FROM range(10)) c),
"""

REST_SQL = VECTOR_CLASSES_SQL + """counts AS (
  SELECT class, score, count(*) FILTER (label = class) AS pos, count(*) FILTER (label <> class) AS neg
  FROM melted GROUP BY ALL),
steps AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY score) AS below FROM counts),
auc AS (SELECT class, sum(pos::DOUBLE * (below - neg / 2.0)) / (sum(pos) * sum(neg))::DOUBLE AS roc_auc FROM steps GROUP BY 1)
"""

ONE_SQL = """, pairs AS (
  SELECT a.class, o.i AS other, a.score, count(*) FILTER (label = class) AS pos, count(*) FILTER (label = o.i) AS neg
  FROM melted a, (SELECT range AS i FROM range(10)) o
  WHERE o.i <> a.class AND (a.label = a.class OR a.label = o.i) GROUP BY ALL),
pair_steps AS (SELECT *, sum(neg) OVER (PARTITION BY class, other ORDER BY score) AS below FROM pairs),
pair_auc AS (
  SELECT class, other, sum(pos::DOUBLE * (below - neg / 2.0)) / (sum(pos) * sum(neg))::DOUBLE AS roc_auc
  FROM pair_steps GROUP BY ALL)
"""


@query("auc_one_vs_rest", REST_SQL + "SELECT class::INTEGER AS class, round(roc_auc, 6) AS roc_auc FROM auc")
def auc_one_vs_rest(t):
    df, scores = _class_scores(t)
    return rounded(C.auc_one_vs_rest(df, "label", scores))


@query(
    "auc_one_vs_one",
    REST_SQL + ONE_SQL + "SELECT class::INTEGER AS class, other::INTEGER AS other, round(roc_auc, 6) AS roc_auc FROM pair_auc",
)
def auc_one_vs_one(t):
    df, scores = _class_scores(t)
    return rounded(C.auc_one_vs_one(df, "label", scores))


@query(
    "multiclass_auc",
    REST_SQL
    + ONE_SQL
    + """SELECT 'roc_auc_ovr' AS metric, round(avg(roc_auc), 6) AS value FROM auc
UNION ALL SELECT 'roc_auc_ovo', round(avg(roc_auc), 6) FROM pair_auc""",
)
def multiclass_auc(t):
    df, scores = _class_scores(t)
    return rounded(C.multiclass_auc(df, "label", scores))


@query(
    "calibration_curve",
    LABELLED_SQL
    + """SELECT ((score > 0.2)::INT + (score > 0.4)::INT + (score > 0.6000000000000001)::INT + (score > 0.8)::INT) AS bin,
       round(avg(label), 6) AS prob_true, round(avg(score), 6)::DOUBLE AS prob_pred, count(*) AS n
FROM scored GROUP BY 1""",
)
def calibration_curve(t):
    return rounded(C.calibration_curve(labelled(t), F.col("label") == 1, F.col("score")))


@query(
    "regression_metrics",
    FIT_SQL
    + """, m AS (
  SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, var_pop(y) AS vy, var_pop(e) AS ve, max(abs(e)) AS top,
         avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM e)
SELECT unnest(['mse', 'rmse', 'mae', 'r2', 'explained_variance', 'max_error', 'mape']) AS metric,
       unnest([round(mse, 4), round(sqrt(mse), 4), round(mae, 4), round(1 - mse / vy, 4), round(1 - ve / vy, 4),
               round(top, 4), round(mape, 4)]) AS value FROM m""",
)
def regression_metrics(t):
    return rounded(R.regression_metrics(fitted(t), "y", "p"), 4)


@query(
    "residual_stats",
    FIT_SQL
    + """, m AS (SELECT avg(e) AS a, stddev_pop(e) AS s, skewness(e) AS g, kurtosis(e) AS k FROM e)
SELECT unnest(['residual_mean', 'residual_std', 'residual_skew', 'residual_kurtosis']) AS metric,
       unnest([round(a, 4), round(s, 4), round(g, 4), round(k, 4)]) AS value FROM m""",
)
def residual_stats(t):
    return rounded(R.residual_stats(fitted(t), "y", "p"), 4)


@query(
    "rmse_by_quartile",
    FIT_SQL
    + """, q AS (SELECT quantile_cont(y, [0.25, 0.5, 0.75]) AS q FROM e)
SELECT 'rmse_range_' || CASE WHEN y <= q[1] THEN 1 WHEN y <= q[2] THEN 2 WHEN y <= q[3] THEN 3 ELSE 4 END AS metric,
       round(sqrt(avg(e * e)), 4) AS value, count(*) AS n
FROM e, q GROUP BY 1""",
)
def rmse_by_quartile(t):
    return rounded(R.rmse_by_quartile(fitted(t), "y", "p"), 4)


POINTS_SQL = """
WITH cells AS (
  SELECT vec_id, label AS cluster, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
centres AS (
  SELECT cluster, dim, avg(x) AS mean, stddev_pop(x) AS std, count(*) AS size, var_pop(x) * count(*) AS squares
  FROM cells GROUP BY ALL),
gaps AS (
  SELECT c.vec_id, c.cluster, sqrt(sum((c.x - m.mean) * (c.x - m.mean))) AS gap
  FROM cells c JOIN centres m ON c.cluster = m.cluster AND c.dim = m.dim GROUP BY ALL),
stats AS (SELECT cluster, count(*) AS size, avg(gap) AS density FROM gaps GROUP BY 1)
"""


@query("cluster_stats", POINTS_SQL + "SELECT cluster, size, round(density, 6) AS density FROM stats")
def cluster_stats(t):
    return rounded(K.cluster_stats(t.embeddings, "embedding", "label"))


@query(
    "cluster_moments",
    POINTS_SQL + "SELECT cluster, dim, round(mean, 6) AS mean, round(std, 6) AS std FROM centres",
)
def cluster_moments(t):
    return rounded(K.cluster_moments(t.embeddings, "embedding", "label"))


@query(
    "calinski_harabasz",
    POINTS_SQL
    + """, overall AS (SELECT dim, avg(x) AS mean FROM cells GROUP BY 1),
b AS (SELECT sum(c.size * (c.mean - o.mean) * (c.mean - o.mean)) AS b, sum(c.squares) AS w FROM centres c JOIN overall o USING (dim)),
k AS (SELECT count(*) AS k, sum(size) AS n FROM stats)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, k""",
)
def calinski_harabasz(t):
    return rounded(K.calinski_harabasz(t.embeddings, "embedding", "label"))


@query(
    "davies_bouldin",
    POINTS_SQL
    + """, apart AS (
  SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) AS gap
  FROM centres a JOIN centres b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL),
worst AS (
  SELECT i, max((s.density + o.density) / gap) AS r FROM apart
  JOIN stats s ON s.cluster = i JOIN stats o ON o.cluster = j GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM worst""",
)
def davies_bouldin(t):
    return rounded(K.davies_bouldin(t.embeddings, "embedding", "label"))


def _silhouette_sql(distance: str, name: str) -> str:
    return f"""WITH pairs AS (
  SELECT a.vec_id, a.label AS own, b.label AS other, a.vec_id = b.vec_id AS self, {distance} AS gap
  FROM (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings) a,
       (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings) b),
sums AS (
  SELECT vec_id, own, other, sum(gap) AS total, count(*) AS n FROM pairs WHERE NOT self GROUP BY ALL),
s AS (
  SELECT vec_id, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
  FROM sums GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS {name} FROM s"""


@query("silhouette", _silhouette_sql("array_distance(a.x, b.x)", "silhouette"))
def silhouette(t):
    return rounded(K.silhouette(t.embeddings, "embedding", "label", "vec_id"))


@query("silhouette_squared", _silhouette_sql("pow(array_distance(a.x, b.x), 2)", "silhouette_squared"))
def silhouette_squared(t):
    return rounded(K.silhouette_squared(t.embeddings, "embedding", "label"))
