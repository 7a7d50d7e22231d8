"""Input checks, batch scoring, the scoring cache and the shape of prediction rows."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from modelyard import settings
from modelyard.functions.values import fingerprint, to_number
from modelyard.operators.profile import require_columns

# Column types that are scored as they are.
KEPT_TYPES = (T.LongType, T.IntegerType, T.DoubleType, T.StringType, T.BooleanType)


def coerce(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Check the required columns and turn columns of other types into numbers."""
    require_columns(df, required)
    odd = [f.name for f in df.schema.fields if not isinstance(f.dataType, KEPT_TYPES) and f.name in set(required)]
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in odd})


def coercion_failures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values that are present but no number."""
    sums = [F.count(F.when(F.col(c).isNotNull() & to_number(F.col(c)).isNull(), 1)).alias(f"f{i}") for i, c in enumerate(columns)]
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("failed")) for i, c in enumerate(columns)]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def concat_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches under each other by column name; a column that a batch lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def pair_actuals(predictions: DataFrame, actuals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions with the value that came true, by key and never by row position.

    `actuals` has the key and `actual_value`; predictions without one are left out.
    """
    return predictions.join(actuals.select(*key, "actual_value"), list(key))


def score_with_cache(
    df: DataFrame,
    inputs: Sequence[str],
    cache: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    now: Column,
    ttl_seconds: int = settings.CACHE_TTL_SECONDS,
) -> DataFrame:
    """Score only rows whose input values have no fresh entry in `cache` (fingerprint, prediction, scored_at).

    The newest fresh entry per fingerprint counts. `model` adds `prediction`; the result tells where it came from.
    """
    keyed = df.withColumn("fingerprint", fingerprint(inputs))
    fresh = (
        cache.where(F.col("scored_at") >= now - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
        .groupBy("fingerprint")
        .agg(F.max_by("prediction", "scored_at").alias("prediction"))
    )
    hits = keyed.join(fresh, "fingerprint").withColumn("cached", F.lit(True))
    misses = model(keyed.join(fresh, "fingerprint", "left_anti")).withColumn("cached", F.lit(False))
    return hits.unionByName(misses.select(*hits.columns))


def prediction_rows(
    scored: DataFrame, time: Column, model_type: str, version: str = "unknown", keep: Sequence[str] = ()
) -> DataFrame:
    """`keep`, the prediction, its time, class probabilities where the model gives them, and model metadata."""
    out = [*[F.col(c) for c in keep], F.col("prediction").cast("double").alias("prediction"), time.alias("prediction_time")]
    if "probability" in scored.columns:
        values = vector_to_array("probability")
        names = F.transform(
            F.sequence(F.lit(0), F.size(values) - 1), lambda j: F.concat(F.lit("class_"), j.cast("string"))
        )
        out += [F.map_from_arrays(names, values).alias("probabilities"), F.array_max(values).alias("confidence")]
    return scored.select(*out, F.lit(model_type).alias("model_type"), F.lit(version).alias("version"))
