"""Classification metrics from a table with a label, a prediction and scores.

Label tables are k x k, so they are small whatever the row count. Everything ordered by score goes through
`ordered.running_totals` after equal scores are merged, so ties are exact and no task holds all scores.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from modelyard.operators.ordered import running_totals


def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, normalise: bool = False) -> DataFrame:
    """Every (label, prediction) cell, zero cells included; `normalise` adds the share of the row."""
    pairs = _pairs(df, label, prediction)
    names = F.array_sort(F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("prediction"))))
    cells = (
        pairs.agg(names.alias("names"))
        .select(F.explode("names").alias("label"), "names")
        .select("label", F.explode("names").alias("prediction"))
    )
    filled = cells.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
    if not normalise:
        return filled
    totals = filled.groupBy("label").agg(F.sum("n").alias("total"))
    return filled.join(totals, "label").select(
        "label",
        "prediction",
        "n",
        F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"),
    )


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of every label seen as truth or prediction; 0 where undefined."""
    pairs = _pairs(df, label, prediction)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("truth"),
                    F.lit(0).cast("long").alias("chosen"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("long").alias("truth"),
                    F.col("n").alias("chosen"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("truth").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit")
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return sums.select(
        "class",
        ratio(F.col("hit"), F.col("chosen")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("chosen") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )


def _averages(classes: DataFrame) -> DataFrame:
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    return classes.agg(
        (F.sum("hit") / total).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"{m}_weighted") for m in measures],
        total.alias("support"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and macro and weighted precision, recall and F1 as (metric, value) rows."""
    names = ["accuracy"] + [f"{m}_{a}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]
    return long_metrics(_averages(per_class(df, label, prediction)), names)


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class rows, then `accuracy`, `macro avg` and `weighted avg`."""
    classes = per_class(df, label, prediction)
    wanted = ["precision", "recall", "f1", "support"]
    rows = classes.select(F.col("class").cast("string").alias("class"), *wanted)
    totals = _averages(classes).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"),
                        *[F.col(source.format(m)).alias(m) for m in ("precision", "recall", "f1")],
                        F.col("support"),
                    )
                    for name, source in (
                        ("accuracy", "accuracy"),
                        ("macro avg", "{}_macro"),
                        ("weighted avg", "{}_weighted"),
                    )
                ]
            )
        )
    )
    return rows.unionByName(totals)


def long_metrics(row: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row as (metric, value) rows."""
    return row.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        )
    )


def _score_totals(
    df: DataFrame, positive: Column, score: Column, group: Sequence[str] = (), ranges: int | None = None, **options
) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score down."""
    rows = df.select(*group, score.cast("double").alias("score"), positive.cast("boolean").alias("positive"))
    counts = (
        rows.groupBy(*group, "score")
        .agg(F.count(F.when(F.col("positive"), 1)).alias("pos"), F.count(F.when(~F.col("positive"), 1)).alias("neg"))
    )
    return running_totals(
        counts, "score", ["pos", "neg"], group, descending=True, ranges=ranges, source=rows, **options
    )


def _auc(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; NULL without both sides."""
    # A positive beats every negative below its score: all negatives minus those at or above it.
    sums = totals.groupBy(*group).agg(
        F.sum("pos").cast("double").alias("positives"),
        F.sum("neg").cast("double").alias("negatives"),
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2)).alias("lost"),
    )
    pairs = F.col("positives") * F.col("negatives")
    return sums.select(*group, F.when(pairs > 0, 1 - F.col("lost") / pairs).alias("roc_auc"))


def roc_auc(df: DataFrame, positive: Column, score: Column, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, one row per group."""
    return _auc(_score_totals(df, positive, score, group), group)


def average_precision(df: DataFrame, positive: Column, score: Column, group: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the recall gained at every distinct score."""
    totals = _score_totals(df, positive, score, group)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return totals.groupBy(*group).agg(
        F.when(F.sum("pos") > 0, F.sum(F.col("pos") * precision) / F.sum("pos")).alias("average_precision")
    )


def _class_totals(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    sums = [F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")]
    return totals.groupBy(*group).agg(*sums) if group else totals.agg(*sums)


def roc_curve(df: DataFrame, positive: Column, score: Column, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, points on a straight line dropped, (0, 0) added without threshold."""
    totals = _score_totals(df, positive, score, look_ahead=True)
    whole = _class_totals(totals, ())
    if drop_intermediate:
        # A point lies on a line when the step into it and the step out of it are the same.
        corner = (
            F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos"))
            | (F.col("next_neg") != F.col("neg"))
            | ((F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg")))
        )
        totals = totals.where(corner)
    points = totals.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), whole.select("negatives").scalar()).alias("fpr"),
        F.try_divide(F.col("cum_pos"), whole.select("positives").scalar()).alias("tpr"),
    )
    start = whole.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(threshold, precision, recall) per distinct score, with the end point (1, 0)."""
    totals = _score_totals(df, positive, score)
    whole = _class_totals(totals, ())
    points = totals.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos"), whole.select("positives").scalar()).alias("recall"),
    )
    end = whole.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _melt_scores(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """One row per (row, class): the true label and the score of that class."""
    entries = [F.struct(F.lit(c).alias("class"), s.cast("double").alias("score")) for c, s in scores.items()]
    return df.select(F.col(label).alias("label"), F.inline(F.array(*entries)))


def auc_one_vs_rest(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """AUC of every class against the others; `scores` maps a class to its score column."""
    melted = _melt_scores(df, label, scores)
    return roc_auc(melted, F.col("label") == F.col("class"), F.col("score"), ["class"])


def auc_one_vs_one(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """For every ordered pair of classes: AUC of `class` against `other` by the score of `class`.

    One running-total pass carries a count per true label, so the rows of a class are not copied for every pair.
    """
    names = list(scores)
    melted = _melt_scores(df, label, scores)
    columns = [f"k{i}" for i in range(len(names))]
    counts = melted.groupBy("class", "score").agg(
        *[F.count(F.when(F.col("label") == F.lit(n), 1)).alias(c) for n, c in zip(names, columns)]
    )
    totals = running_totals(counts, "score", columns, ["class"], source=melted)
    own = F.lit(0)
    for n, c in zip(names, columns):
        own = F.when(F.col("class") == F.lit(n), F.col(c)).otherwise(own)
    sums = totals.withColumn("own", own.cast("double")).groupBy("class").agg(
        F.sum("own").alias("positives"),
        *[F.sum(c).alias(f"n_{c}") for c in columns],
        *[F.sum(F.col("own") * (F.col(f"cum_{c}") - F.col(c) / 2)).alias(f"w_{c}") for c in columns],
    )
    cells = [
        F.struct(F.lit(n).alias("other"), F.col(f"n_{c}").alias("negatives"), F.col(f"w_{c}").alias("won"))
        for n, c in zip(names, columns)
    ]
    pairs = F.col("positives") * F.col("negatives")
    return (
        sums.select("class", "positives", F.inline(F.array(*cells)))
        .where(F.col("class") != F.col("other"))
        .select("class", "other", F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"))
    )


def multiclass_auc(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Macro averages `roc_auc_ovr` and `roc_auc_ovo` as (metric, value) rows."""
    rest = auc_one_vs_rest(df, label, scores).agg(F.avg("roc_auc").alias("value"))
    one = auc_one_vs_one(df, label, scores).agg(F.avg("roc_auc").alias("value"))
    return rest.select(F.lit("roc_auc_ovr").alias("metric"), "value").unionByName(
        one.select(F.lit("roc_auc_ovo").alias("metric"), "value")
    )


def calibration_curve(df: DataFrame, positive: Column, score: Column, bins: int = 5) -> DataFrame:
    """Mean score and share of positives per equal-width bin; a score on an edge belongs below; empty bins are absent."""
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    number = F.lit(0)
    for edge in edges:
        number = number + (score.cast("double") > F.lit(edge)).cast("int")
    return (
        df.select(number.alias("bin"), positive.cast("double").alias("y"), score.cast("double").alias("p"))
        .groupBy("bin")
        .agg(F.avg("y").alias("prob_true"), F.avg("p").alias("prob_pred"), F.count("*").alias("n"))
    )
