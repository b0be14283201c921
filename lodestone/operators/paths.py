"""Ordered paths: moves of a printer, polylines and sequences of frames, as windows along one order by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def colour_changes(moves: DataFrame, by: list[str], order: list[str], colour: str) -> DataFrame:
    """Moves before which the colour changes; the first move of a key changes to its colour."""
    return moves.where(~F.col(colour).isNull()).withColumn("before", F.lag(colour).over(_order(by, order))).where(F.col("before").isNull() | (F.col("before") != F.col(colour)))


def filament(length: Column, width: float, height: float, diameter: float) -> Column:
    """Length of filament that a printed line of this length takes."""
    return length * (width * height / (math.pi * (diameter / 2) ** 2))


def running_total(moves: DataFrame, by: list[str], order: list[str], amount: Column, name: str = "total") -> DataFrame:
    """What has been used up to each move, itself included."""
    return moves.withColumn(name, F.sum(amount).over(_order(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def overhangs(layers: DataFrame, by: list[str], order: list[str], area: str, factor: float = 1.1) -> DataFrame:
    """Layers whose area is over `factor` times that of the layer below."""
    return layers.withColumn("below", F.lag(area).over(_order(by, order))).where(F.col(area) > factor * F.col("below"))


def last_frames(frames: DataFrame, by: list[str], order: list[str], value: str, count: int) -> DataFrame:
    """Each frame with the values of the last `count` frames, itself included, oldest first: a bounded memory."""
    return frames.withColumn("memory", F.collect_list(value).over(_order(by, order).rowsBetween(1 - count, 0)))


def even_points(points: DataFrame, by: list[str], order: list[str], axes: list[str], step: float) -> DataFrame:
    """Points of a polyline at even steps of its length, the first point included: key, place (0, 1, ..) and axes."""
    o = _order(by, order)
    before = [F.lag(a).over(o).alias(f"{a}0") for a in axes]
    parts = points.select(*by, *order, *axes, *before)
    length = F.sqrt(sum((F.pow(F.col(a) - F.col(f"{a}0"), F.lit(2.0)) for a in axes), F.lit(0.0)))
    parts = parts.withColumn("length", F.coalesce(length, F.lit(0.0))).withColumn("until", F.sum("length").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("until") - F.col("length")
    first, last = F.floor(start / step) + 1, F.floor(F.col("until") / step)
    inner = parts.where((F.col("length") > 0) & (last >= first)).withColumn("place", F.explode(F.sequence(first, last)))
    share = (F.col("place") * step - start) / F.col("length")
    inner = inner.select(*by, "place", *[(F.col(f"{a}0") + share * (F.col(a) - F.col(f"{a}0"))).alias(a) for a in axes])
    head = parts.where(F.col(f"{axes[0]}0").isNull()).select(*by, F.lit(0).cast("long").alias("place"), *axes)
    return head.unionByName(inner)


def densified(points: DataFrame, by: list[str], order: list[str], axes: list[str]) -> DataFrame:
    """A closed contour with points at most one apart: each side is cut into as many steps as it is long, rounded up."""
    o = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.coalesce(F.lead(a).over(o), F.first(a).over(whole)).alias(f"{a}1") for a in axes]
    sides = points.select(*by, *order, *axes, *after)
    length = F.sqrt(sum((F.pow(F.col(f"{a}1") - F.col(a), F.lit(2.0)) for a in axes), F.lit(0.0)))
    sides = sides.withColumn("steps", F.greatest(F.lit(1), F.ceil(length).cast("int"))).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    return sides.select(*by, *order, "step", *[(F.col(a) + (F.col(f"{a}1") - F.col(a)) * F.col("step") / F.col("steps")).alias(a) for a in axes])


def command_counts(lines: DataFrame, text: str) -> DataFrame:
    """Lines of a print job by command; comments and empty lines apart."""
    word = F.regexp_extract(F.trim(text), r"^([A-Z]\d+)", 1)
    kind = F.when(F.trim(text) == "", F.lit("empty")).when(F.trim(text).startswith(";"), F.lit("comment")).when(word != "", word).otherwise(F.lit("other"))
    return lines.groupBy(kind.alias("command")).agg(F.count("*").alias("n"))
