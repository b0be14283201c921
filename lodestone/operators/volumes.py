"""Volumes in long form (x, y, z, v): value maps, slice geometry, adaptive thresholds, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .connected import components, touching
from .matching import grouped_by_gap
from .ranking import saved

AXES = ["x", "y", "z"]


def linear_map(raw: Column, slope: float, intercept: float) -> Column:
    """Raw values to units (uptake, attenuation)."""
    return raw * slope + intercept


def inverse_map(value: Column, slope: float, intercept: float) -> Column:
    """Units to raw values; 0 for a zero slope."""
    return F.lit(0.0) if slope == 0 else (value - intercept) / slope


def slice_places(slices: DataFrame, position: str, normal: str) -> DataFrame:
    """Adds `place`, the position along the normal (arrays of three), by which slices are ordered."""
    products = F.zip_with(position, normal, lambda a, b: a * b)
    return slices.withColumn("place", F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def slice_spacing(places: DataFrame, by: list[str], default: float) -> DataFrame:
    """Mean distance of consecutive slices by series; the default for a single slice."""
    w = Window.partitionBy(*by).orderBy("place")
    steps = places.withColumn("_d", F.abs(F.col("place") - F.lag("place").over(w)))
    return steps.groupBy(*by).agg(F.coalesce(F.avg("_d"), F.lit(default)).alias("spacing"))


def index_of(width: int, height: int) -> Column:
    return (F.col("z") * height + F.col("y")) * width + F.col("x")


def adaptive_region(cells: DataFrame, seed: dict[str, int], width: int, height: int, box: int = 5, rounds: int = 15, share: float = 0.9) -> tuple[DataFrame, float]:
    """Region of a seed at the weight of the local maximum, found by bisection, that makes it at most `share` of the
    half-maximum region (at least 5 cells); the region and the weight. Cells under the lowest tried level never count,
    so the search works on the half-maximum region's cells and those above only."""
    near, at = F.lit(True), F.lit(True)
    for a, s in seed.items():
        near, at = near & F.col(a).between(s - box, s + box), at & (F.col(a) == s)
    top = cells.where(near).agg(F.max("v")).first()[0]
    kept = saved(cells.where(F.col("v") >= 0.1 * top) if top > 0 else cells)

    def region(weight: float) -> DataFrame:
        passed = components(kept.where(F.col("v") >= weight * top), AXES, index_of(width, height), 6)
        return touching(passed, passed.where(at), AXES)

    target = max(5, int(share * region(0.5).count()))
    low, high = 0.1, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if region(middle).count() > target else (low, middle)
    weight = (low + high) / 2
    return region(weight), weight


def side_of(x: Column, y: Column, cx: float, cy: float) -> Column:
    """Top if clearly above the centre, else left or right of it."""
    dx, dy = x - cx, y - cy
    return F.when(dy < -F.abs(dx) * 0.5, "Top").when(dx < 0, "Left").otherwise("Right")


def markers(cells: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float], high: float = 1000, middle: float = 390, least: int = 3, most: int = 2000, tolerance: float = 5.0, groups: int = 10) -> DataFrame:
    """Dense marker points: 26-connected components of least to most cells over the high level, and over the middle one if
    fewer than three are found; typed by side, grouped by height (within the tolerance of each group's first), and each
    group of two or more with its mean as `Center`. Columns grp, type, x, y, z in physical units."""
    def found(mask: DataFrame) -> DataFrame:
        labelled = components(mask, AXES, index_of(size[0], size[1]), 26)
        centre = labelled.groupBy("label").agg(F.count("*").alias("n"), *[(F.avg(a) * s).alias(a) for a, s in zip(AXES, spacing, strict=True)])
        return centre.where(F.col("n").between(least, most)).select("n", *AXES)

    points = found(cells.where(F.col("v") >= high))
    if points.limit(3).count() < 3:
        points = points.union(found(cells.where((F.col("v") >= middle) & (F.col("v") < high))))
    typed = points.withColumn("type", side_of(F.col("x"), F.col("y"), size[0] * spacing[0] / 2, size[1] * spacing[1] / 2)).withColumn("scan", F.lit(0))
    grouped = grouped_by_gap(typed, ["scan"], "z", tolerance).where(F.col("grp") < groups)
    centres = grouped.groupBy("grp").agg(F.count("*").alias("_k"), *[F.avg(a).alias(a) for a in AXES]).where("_k >= 2")
    return grouped.select("grp", "type", *AXES).union(centres.select("grp", F.lit("Center").alias("type"), *AXES))


def support_rows(cells: DataFrame, level: float, low: int, high: int) -> DataFrame:
    """For each slice the row (within low..high) with most cells at or over the level, the first of equals, and how many."""
    counts = cells.where((F.col("v") >= level) & F.col("y").between(low, high)).groupBy("z", "y").agg(F.count("*").alias("n"))
    return counts.groupBy("z").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y"), F.max("n").alias("n"))
