"""Connected components of sparse grids and graphs, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import rooted
from .ranking import saved, with_rank

OFFSETS = {
    4: [(1, 0), (0, 1)],
    8: [(1, 0), (0, 1), (1, 1), (1, -1)],
    6: [(1, 0, 0), (0, 1, 0), (0, 0, 1)],
    26: [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dz, dy, dx) > (0, 0, 0)],
}


def label_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id; edges: a, b (each once, either way). Gives id and label, the smallest id of the component."""
    found = rooted(edges).select("id", F.col("root").alias("label"))
    return nodes.select("id").join(found.hint("merge"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def grid_edges(cells: DataFrame, axes: list[str], connectivity: int) -> DataFrame:
    """Pairs of neighbouring cells; cells: axes and id."""
    d = [f"d{a}" for a in axes]
    shifts = F.explode(F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(offset, d, strict=True)]) for offset in OFFSETS[connectivity]])).alias("_d")
    moved = cells.select(F.col("id").alias("a"), *axes, shifts).select("a", *[(F.col(a) + F.col(f"_d.{n}")).alias(a) for a, n in zip(axes, d, strict=True)])
    # Spark takes cells for as small as their file, where whole runs of them are a few bytes, and would broadcast them.
    return moved.hint("merge").join(cells.select(*axes, F.col("id").alias("b")).hint("merge"), axes).select("a", "b")


def components(cells: DataFrame, axes: list[str], index: Column, connectivity: int) -> DataFrame:
    """Cells of a mask with label (smallest index of the component); index is the place in scan order."""
    rows = saved(cells.select(*axes, index.cast("long").alias("id")))
    return rows.join(label_graph(rows.select("id"), grid_edges(rows, axes, connectivity)).hint("merge"), "id")


def numbered(labelled: DataFrame) -> DataFrame:
    """Labels 1 .. n in scan order instead of indexes."""
    names = with_rank(labelled.select("label").distinct(), "label").select("label", (F.col("rank") + 1).cast("int").alias("number"))
    return labelled.join(names, "label").drop("label").withColumnRenamed("number", "label")


def largest(labelled: DataFrame) -> DataFrame:
    """Cells of the component with most cells, of equals the first in scan order."""
    best = labelled.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labelled.join(F.broadcast(best), "label", "left_semi")


def touching(labelled: DataFrame, seeds: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the components that hold any seed."""
    wanted = labelled.join(seeds.select(*axes).distinct(), axes, "left_semi").select("label").distinct()
    return labelled.join(wanted, "label", "left_semi")


def within(v: Column, mean: Column, how: str, a: float, b: float = 0.0) -> Column:
    """Region criterion: 'threshold' a <= v <= b, 'difference' |v - mean| <= a, 'ratio' |v / mean - 1| <= a (|v| < a near a zero mean)."""
    if how == "threshold":
        return v.between(a, b)
    if how == "difference":
        return F.abs(v - mean) <= a
    return F.when(F.abs(mean) < 1e-12, F.abs(v) < a).otherwise(F.abs(v / mean - 1) <= a)


def grow(cells: DataFrame, seeds: DataFrame, criterion, axes: list[str], index: Column, connectivity: int) -> DataFrame:
    """Region growing: cells that pass criterion(value, mean of the seeds) and are connected with a seed; seeds always belong."""
    at_seeds = cells.join(seeds.select(*axes, F.lit(True).alias("_seed")), axes, "left")
    mean = cells.join(seeds, axes, "left_semi").agg(F.avg("v").alias("_mean"))
    passed = at_seeds.join(F.broadcast(mean)).where(F.coalesce(F.col("_seed"), F.lit(False)) | criterion(F.col("v"), F.col("_mean")))
    return touching(components(passed, axes, index, connectivity), seeds, axes)


def fill_holes(mask: DataFrame, frame: DataFrame, axes: list[str], index: Column, border: Column) -> DataFrame:
    """The mask and all background of the frame that no 4-connected way leads from to the border."""
    background = components(frame.join(mask, axes, "left_anti"), axes, index, 4)
    outside = background.where(border).select("label").distinct()
    return mask.select(*axes).union(background.join(outside, "label", "left_anti").select(*axes))


def threshold_region(cells: DataFrame, seed: dict[str, int], share: float | None, level: float | None, axes: list[str], index: Column, connectivity: int, box: int = 5) -> DataFrame:
    """Cells at or over a level (or a share of the largest value in the box round the seed) connected with the seed; none if the seed is below."""
    at = F.lit(True)
    near = F.lit(True)
    for a, s in seed.items():
        at, near = at & (F.col(a) == s), near & F.col(a).between(s - box, s + box)
    limit = F.lit(level)
    if level is None:
        limit = F.lit(share) * cells.where(near).agg(F.max("v")).first()[0]
    passed = components(cells.where(F.col("v") >= limit), axes, index, connectivity)
    return touching(passed, passed.where(at), axes)
