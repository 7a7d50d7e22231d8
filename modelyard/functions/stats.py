"""Statistics Spark has no built-in for, as column expressions and small Arrow helpers."""

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def corrected_skewness(column) -> Column:
    """Bias-corrected sample skewness (NULL below 3 rows)."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(column) -> Column:
    """Bias-corrected excess kurtosis (NULL below 4 rows)."""
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def kolmogorov_p(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Large-sample two-sided p-value of a two-sample KS statistic.

    2 * sum((-1)^(j-1) * exp(-2 j^2 L^2)) with L = D * sqrt(nm/(n+m)); 1 below L = 0.2, where the series is unstable.
    """
    scale = F.try_divide(n.cast("double") * m.cast("double"), n.cast("double") + m.cast("double"))
    x = statistic * F.sqrt(scale)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * j * j * x * x),
    )
    p = F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
    return F.when(statistic.isNotNull(), p)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c = 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi_square_tail(statistic: float, dof: float) -> float:
    """P(X > statistic) for a chi-square with `dof` degrees of freedom."""
    if statistic is None or dof is None or math.isnan(statistic):
        return float("nan")
    return 1.0 if dof <= 0 else _upper_gamma(dof / 2.0, statistic / 2.0)


def f_tail(statistic: float, d1: float, d2: float) -> float:
    """P(F > statistic), through the regularised incomplete beta function."""
    if statistic is None or math.isnan(statistic):
        return float("nan")
    if statistic <= 0:
        return 1.0
    if math.isinf(statistic):
        return 0.0
    return _beta_cdf(d2 / (d2 + d1 * statistic), d2 / 2.0, d1 / 2.0)


def _beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_cdf(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d or 1e-300)
            c = 1.0 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """p-value per row; meant for result tables with one row per feature."""

    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(a, b) for a, b in zip(x, d)], dtype="float64")

    return pandas_udf(tail, "double")(statistic, dof)
