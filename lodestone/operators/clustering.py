"""One-dimensional clustering by passes of sums: k-means with evenly picked starts, Gaussian mixtures by EM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank


def evenly_picked(rows: DataFrame, v: str, order: str, k: int) -> list[float]:
    """The values at places i * (n div k) of the order."""
    n = rows.count()
    step = max(n // k, 1)
    ranked = with_rank(rows.select(v, order), order)
    return [r[0] for r in ranked.where(F.col("rank").isin([i * step for i in range(k) if i * step < n])).orderBy("rank").select(v).collect()]


def closest(v: Column, centres: list[float]) -> Column:
    """Number of the nearest centre, the lower of equals."""
    best, at = F.abs(v - centres[0]), F.lit(0)
    for i, c in enumerate(centres[1:], 1):
        d = F.abs(v - c)
        at, best = F.when(d < best, i).otherwise(at), F.least(d, best)
    return at


def kmeans(rows: DataFrame, v: str, centres: list[float], rounds: int, tolerance: float = 0.0) -> list[float]:
    """Centres after `rounds` passes, or sooner if they move by less than the tolerance in sum; empty clusters stay."""
    for _ in range(rounds):
        found = {r["c"]: r["m"] for r in rows.groupBy(closest(F.col(v), centres).alias("c")).agg(F.avg(v).alias("m")).collect()}
        new = [found.get(i, c) for i, c in enumerate(centres)]
        moved = sum(abs(a - b) for a, b in zip(new, centres, strict=True))
        centres = new
        if moved < tolerance:
            break
    return centres


def gaussian(v: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow((v - mean) / sd, F.lit(2.0)) / 2) / (sd * math.sqrt(2 * math.pi))


def mixture(rows: DataFrame, v: str, k: int, rounds: int, floor: float = 1e-3) -> list[tuple[float, float, float]]:
    """(weight, mean, sd) of k Gaussians after EM; means start evenly over the range, and sd never falls below the floor."""
    low, high, sd = rows.agg(F.min(v), F.max(v), F.stddev_pop(v)).first()
    parts = [(1 / k, low + (high - low) * (i + 0.5) / k, max(sd / k, floor)) for i in range(k)]
    for _ in range(rounds):
        p = [w * gaussian(F.col(v), m, s) for w, m, s in parts]
        total = F.greatest(sum(p[1:], p[0]), F.lit(1e-300))
        r = [x / total for x in p]
        sums = rows.agg(F.count("*"), *[e for x in r for e in (F.sum(x), F.sum(x * F.col(v)), F.sum(x * F.col(v) * F.col(v)))]).first()
        n, new = sums[0], []
        for i in range(k):
            s0, s1, s2 = sums[1 + 3 * i : 4 + 3 * i]
            m = s1 / max(s0, 1e-300)
            new.append((s0 / n, m, max(math.sqrt(max(s2 / max(s0, 1e-300) - m * m, 0.0)), floor)))
        parts = new
    return parts
