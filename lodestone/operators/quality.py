"""Quality of images, masks and deformations that needs neighbours: structural similarity, surface distance, Jacobians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import box_mean
from .ranking import quantiles


def structural_similarity(pairs: DataFrame, radius: int = 3, peak: float = 1.0) -> DataFrame:
    """Mean SSIM of two images (x, y, a, b) with uniform windows; what lies outside counts as zero."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    out = pairs
    for name, value in (("ma", F.col("a")), ("mb", F.col("b")), ("maa", F.col("a") * F.col("a")), ("mbb", F.col("b") * F.col("b")), ("mab", F.col("a") * F.col("b"))):
        out = box_mean(out.withColumn("v", value), radius).withColumnRenamed("v", name)
    a, b = F.col("ma"), F.col("mb")
    va, vb, ab = F.col("maa") - a * a, F.col("mbb") - b * b, F.col("mab") - a * b
    score = (2 * a * b + c1) * (2 * ab + c2) / ((a * a + b * b + c1) * (va + vb + c2))
    return out.agg(F.avg(score).alias("ssim"))


def squared_distances(points: DataFrame, mask: DataFrame, frame: DataFrame) -> DataFrame:
    """Each point (x, y) with the squared distance to the nearest cell of the mask. Distances along columns come from
    windows over the frame's cells, and each point then looks along its own row: exact, with as many pairs a point as
    the frame is wide."""
    cells = frame.select("x", "y").join(mask.select("x", "y", F.lit(True).alias("on")), ["x", "y"], "left")
    w = Window.partitionBy("x").orderBy("y")
    before = F.last(F.when(F.col("on"), F.col("y")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Both ways as running windows: Spark reads a frame up to the last row anew for each row.
    down = Window.partitionBy("x").orderBy(F.desc("y"))
    after = F.last(F.when(F.col("on"), F.col("y")), True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    g = F.least(F.col("y") - before, after - F.col("y"))
    column = cells.withColumn("g", g).where("g is not null").select(F.col("x").alias("x2"), "y", "g")
    d = F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow("g", F.lit(2.0))
    return points.select("x", "y").join(column, "y").groupBy("x", "y").agg(F.min(d).alias("d2"))


def hausdorff_95(a: DataFrame, b: DataFrame, frame: DataFrame) -> DataFrame:
    """95th percentile (linear) of the distances of all cells of each mask to the other; 0 if both are empty, infinite if one is."""
    both = squared_distances(a, b, frame).union(squared_distances(b, a, frame))
    sizes = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb")))
    out = sizes.join(quantiles(both.select(F.sqrt("d2").alias("d")), "d", [0.95]).toDF("p"), how="left")
    empty = F.when((F.col("na") == 0) & (F.col("nb") == 0), 0.0).when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(float("inf")))
    return out.select(F.coalesce(empty, "p").alias("hd95"))


def jacobian(flow: DataFrame) -> DataFrame:
    """Determinant of the deformation x + u(x) at inner cells of a flow (x, y, ux, uy), by central differences."""
    along = {"x": Window.partitionBy("y").orderBy("x"), "y": Window.partitionBy("x").orderBy("y")}
    d = {(c, a): (F.lead(c).over(w) - F.lag(c).over(w)) / 2 for c in ("ux", "uy") for a, w in along.items()}
    det = (1 + d["ux", "x"]) * (1 + d["uy", "y"]) - d["ux", "y"] * d["uy", "x"]
    return flow.withColumn("det", det).where("det is not null").select("x", "y", "det")


def jacobian_statistics(flow: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and the share of folded cells."""
    d = F.col("det")
    return jacobian(flow).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.min(d).alias("lowest"), F.max(d).alias("highest"), F.avg((d <= 0).cast("double")).alias("folding"))


def landmark_error(flow: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Distances between landmarks (px, py) moved by the flow (sampled bilinearly) and their targets (tx, ty)."""
    taps = F.explode(F.array(*[F.struct((F.floor("px") + dx).cast("long").alias("x"), (F.floor("py") + dy).cast("long").alias("y"), ((F.col("px") - F.floor("px") if dx else 1 - (F.col("px") - F.floor("px"))) * (F.col("py") - F.floor("py") if dy else 1 - (F.col("py") - F.floor("py")))).alias("w")) for dx in (0, 1) for dy in (0, 1)]))
    near = landmarks.select("id", "px", "py", "tx", "ty", taps.alias("t")).select("*", "t.x", "t.y", "t.w").join(flow, ["x", "y"])
    moved = near.groupBy("id", "px", "py", "tx", "ty").agg(F.sum(F.col("w") * F.col("ux")).alias("sx"), F.sum(F.col("w") * F.col("uy")).alias("sy"))
    e = F.sqrt(F.pow(F.col("px") + F.col("sx") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("py") + F.col("sy") - F.col("ty"), F.lit(2.0)))
    return moved.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.median(e).alias("median"), F.max(e).alias("highest"), F.min(e).alias("lowest"))
