"""Models side by side."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def mark_best(table: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Add `best`: whether a row holds the best value of `metric`."""
    top = table.agg((F.max if higher_is_better else F.min)(metric)).scalar()
    return table.withColumn("best", F.col(metric) == top)


def side_by_side(long: DataFrame, metrics: Sequence[str], group: str = "model_id") -> DataFrame:
    """(model_id, metric, value) rows as one row per model and one column per wanted metric."""
    wide = long.where(F.col("metric").isin(*metrics)).groupBy(group).pivot("metric", list(metrics))
    return wide.agg(F.first("value"))
