"""Distribution functions that Spark SQL lacks, as Arrow-batched functions of columns."""

from __future__ import annotations

import math
from functools import cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(q: float, df: float) -> float:
    """P(X > q) with df degrees of freedom; 1 without any."""
    return _gamma_upper(df / 2, q / 2) if df > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return _beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@cache
def _discordant_tails(n: int) -> list[float]:
    """Share of all orders of n ranks with at most k discordant pairs, for each k."""
    counts = [1]
    for m in range(2, n + 1):
        sums = list(accumulate(counts, initial=0))
        counts = [sums[min(k + 1, len(counts))] - sums[max(0, k - m + 1)] for k in range(len(counts) + m - 1)]
    total = math.factorial(n)
    return [c / total for c in accumulate(counts)]


def kendall_two_sided(s: float, n: float, tied_x: tuple[float, float, float], tied_y: tuple[float, float, float]) -> float:
    """Two-sided p-value of Kendall's s over n rows. Without ties and with 33 rows at most (or with the rows nearly in one
    order) it is exact, else by the normal distribution. tied: sums over groups of t equal values of t(t-1)/2,
    t(t-1)(t-2) and t(t-1)(2t+5)."""
    n, pairs = int(n), int(n) * (int(n) - 1) // 2
    if not tied_x[0] and not tied_y[0]:
        least = (pairs - abs(int(s))) // 2
        if n <= 33:
            return min(1.0, 2 * _discordant_tails(n)[least]) if 2 * least != pairs else 1.0
        if least <= 1:
            return 2 * math.exp(-math.lgamma(n + 1 - least))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - tied_x[2] - tied_y[2]) / 18 + 2 * tied_x[0] * tied_y[0] / m + tied_x[1] * tied_y[1] / (9 * m * (n - 2))
    return normal_two_sided(s / math.sqrt(var)) if var > 0 else float("nan")


def _over(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def chi2_tail_column(q, df):
    return _over(chi2_tail)(q, df)


def t_two_sided_column(t, df):
    return _over(t_two_sided)(t, df)


def normal_two_sided_column(z):
    return _over(lambda x, _: normal_two_sided(x))(z, F.lit(0.0))
