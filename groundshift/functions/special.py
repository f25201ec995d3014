"""Special functions that Spark lacks: the normal tail and Student's t."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; null for null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))

    return F.pandas_udf(run, "double")(z)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_tail(rho: float | None, n: int) -> float | None:
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    freedom = n - 2
    t2 = rho * rho * freedom / (1 - rho * rho)
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t2))


def t_two_sided(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs."""

    def run(r: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([t_tail(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, m, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(rho, n)
