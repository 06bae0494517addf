"""Critical values of rank comparisons for any number of algorithms and any level, by numerical integration."""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_POINTS, _REACH = 4001, 9.0


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2.0)) for v in z.ravel()]).reshape(z.shape)


@cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, Simpson weights times the normal density, and the normal distribution at the points."""
    z = np.linspace(-_REACH, _REACH, _POINTS)
    simpson = np.where(np.arange(_POINTS) % 2 == 1, 4.0, 2.0)
    simpson[[0, -1]] = 1.0
    return z, simpson * (z[1] - z[0]) / 3.0 * np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi), _normal(z)


def range_distribution(q: float, k: int) -> float:
    """Probability that the range of ``k`` standard normal numbers is at most ``q``: the largest is at z, the others not below z - q."""
    z, weight, below = _grid()
    return float(k * (weight * np.maximum(below - _normal(z - q), 0.0) ** (k - 1)).sum())


@cache
def nemenyi_quantile(k: int, alpha: float) -> float:
    """Upper quantile of the range of ``k`` normal numbers, over the root of two."""
    if k < 2 or not 0.0 < alpha < 1.0:
        raise ValueError(f"no critical value for {k} algorithms at {alpha}")
    low, high = 0.0, 2.0
    while range_distribution(high, k) < 1.0 - alpha:
        high *= 2.0
    for _ in range(60):
        middle = (low + high) / 2.0
        low, high = (middle, high) if range_distribution(middle, k) < 1.0 - alpha else (low, middle)
    return (low + high) / 2.0 / math.sqrt(2.0)


def dunn_quantile(k: int, alpha: float) -> float:
    """Normal quantile of the level shared by the ``k - 1`` comparisons with a control, two-sided."""
    if k < 2 or not 0.0 < alpha < 1.0:
        raise ValueError(f"no critical value for {k} algorithms at {alpha}")
    return NormalDist().inv_cdf(1.0 - alpha / (2.0 * (k - 1)))


QUANTILES = {"nemenyi": nemenyi_quantile, "bonferroni-dunn": dunn_quantile}


def computed_critical_value(test: str, alpha: float, k: Column) -> Column:
    """Critical value for ``k`` algorithms, made for the one row of a result. Null without algorithms to compare."""
    if test not in QUANTILES:
        raise ValueError(f"unknown test {test}")

    @F.pandas_udf("double")
    def value(counts: pd.Series) -> pd.Series:
        return pd.Series([QUANTILES[test](int(c), alpha) if c is not None and c >= 2 else None for c in counts], dtype="float64")

    return value(k.cast("int"))
