"""Column functions for proportions, hazard ratios and their intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def double_arcsine(p: Column, n: Column) -> Column:
    """Freeman-Tukey transform of a proportion of n."""
    return F.asin(F.sqrt(clip01(p * n / (n + 1)))) + F.asin(F.sqrt(clip01((p * n + 1) / (n + 1))))


def from_double_arcsine(t: Column) -> Column:
    """Back to a proportion; below zero it folds upward."""
    return F.pow(F.sin(t / 2), F.lit(2.0))


def log_ratio_error(low: Column, high: Column) -> Column:
    """Standard error of a log ratio from its 95 % interval, at least 1e-6."""
    return F.greatest((F.log(high) - F.log(low)) / (2 * Z95), F.lit(1e-6))
