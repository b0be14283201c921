"""Volumes as tables of cells (x, y, z, v): stencils, resampling, morphology and measures in three dimensions.

Dense volumes are walked along one axis at a time with windows over the two others, so no cell is joined with its
neighbours; separable filters and resampling are three such passes. Sparse masks meet a broadcast table of offsets, whose
size is that of the ball and not of the data.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import rooted
from .connected import components

AXES = ["x", "y", "z"]
#: Neighbours that share a face.
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def line(axis: str) -> Window:
    """All cells of a line along the axis, in order."""
    return Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)


def box_mean(cells: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Means of the columns in cubes of side 2 * radius + 1; what lies outside counts as zero."""
    for axis in AXES:
        w = line(axis).rangeBetween(-radius, radius)
        cells = cells.withColumns({n: F.sum(n).over(w) / (2 * radius + 1) for n in names})
    return cells


def structural_similarity(pairs: DataFrame, radius: int = 3, peak: float = 1.0) -> DataFrame:
    """Mean SSIM of two volumes (x, y, z, a, b) with uniform cubes."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    a, b = F.col("a"), F.col("b")
    m = box_mean(pairs.select(*AXES, a.alias("ma"), b.alias("mb"), (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab")), ["ma", "mb", "aa", "bb", "ab"], radius)
    a, b = F.col("ma"), F.col("mb")
    va, vb, ab = F.col("aa") - a * a, F.col("bb") - b * b, F.col("ab") - a * b
    return m.agg(F.avg((2 * a * b + c1) * (2 * ab + c2) / ((a * a + b * b + c1) * (va + vb + c2))).alias("ssim"))


def local_correlation(pairs: DataFrame, radius: int = 4) -> DataFrame:
    """Mean of the local correlation coefficients of two volumes; deviations are taken from each cell's own mean."""
    m = box_mean(pairs.select(*AXES, "a", "b", F.col("a").alias("ma"), F.col("b").alias("mb")), ["ma", "mb"], radius)
    da, db = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    m = box_mean(m.select(*AXES, (da * db).alias("ab"), (da * da).alias("aa"), (db * db).alias("bb")), ["ab", "aa", "bb"], radius)
    # Sums of rounded terms may fall below zero where a window is flat.
    return m.agg(F.avg(F.col("ab") / (F.sqrt(F.greatest(F.col("aa") * F.col("bb"), F.lit(0.0))) + 1e-5)).alias("ncc"))


def peak_ratio(pairs: DataFrame, peak: float = 1.0) -> DataFrame:
    """Mean squared error and peak signal-to-noise ratio, infinite for equal volumes."""
    return pairs.agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse")).withColumn("psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.col("mse"))))


def jacobian(flow: DataFrame) -> DataFrame:
    """Determinant of identity plus the flow's central differences, for inner cells; flow: x, y, z, dx, dy, dz."""
    slopes = {f"{d}_{a}": (F.lead(d).over(line(a)) - F.lag(d).over(line(a))) / 2 for d in ("dx", "dy", "dz") for a in AXES}
    c = {k: F.col(k) for k in slopes}
    xx, yy, zz = 1 + c["dx_x"], 1 + c["dy_y"], 1 + c["dz_z"]
    det = zz * (yy * xx - c["dy_x"] * c["dx_y"]) - c["dz_y"] * (c["dy_z"] * xx - c["dy_x"] * c["dx_z"]) + c["dz_x"] * (c["dy_z"] * c["dx_y"] - yy * c["dx_z"])
    return flow.withColumns(slopes).withColumn("det", det).where("det is not null").select(*AXES, "det")


def jacobian_statistics(flow: DataFrame) -> DataFrame:
    """Mean, sample deviation, least and largest determinant, and the share of folded cells (not over zero)."""
    det = F.col("det")
    return jacobian(flow).agg(F.avg(det).alias("mean"), F.stddev_samp(det).alias("sd"), F.min(det).alias("least"), F.max(det).alias("largest"), F.avg((det <= 0).cast("double")).alias("folded"))


def gradient_penalty(flow: DataFrame) -> DataFrame:
    """Sum over the axes of the mean squared forward differences, over all components of the flow."""
    steps = {f"{d}_{a}": F.pow(F.lead(d).over(line(a)) - F.col(d), F.lit(2.0)) for d in ("dx", "dy", "dz") for a in AXES}
    means = sum((F.sum(F.col(f"dx_{a}") + F.col(f"dy_{a}") + F.col(f"dz_{a}")) / (3 * F.count(f"dx_{a}")) for a in AXES), F.lit(0.0))
    return flow.withColumns(steps).agg(means.alias("penalty"))


def bending_energy(flow: DataFrame) -> DataFrame:
    """Mean squared second differences along the axes, and twice those across each two of them."""
    names, columns = ("dx", "dy", "dz"), {}
    for a in AXES:
        columns |= {f"{d}_{a}{a}": F.lead(d).over(line(a)) + F.lag(d).over(line(a)) - 2 * F.col(d) for d in names}
    flow = flow.withColumns(columns).withColumns({f"{d}_{a}": F.lead(d).over(line(a)) - F.col(d) for d in names for a in ("x", "y")})
    flow = flow.withColumns({f"{d}_{a}{b}": F.lead(f"{d}_{a}").over(line(b)) - F.col(f"{d}_{a}") for d in names for a, b in (("x", "y"), ("x", "z"), ("y", "z"))})
    mean = lambda k: sum((F.sum(F.col(f"{d}_{k}") * F.col(f"{d}_{k}")) for d in names), F.lit(0.0)) / (3 * F.count(f"dx_{k}"))
    return flow.agg((mean("xx") + mean("yy") + mean("zz") + 2 * (mean("xy") + mean("xz") + mean("yz"))).alias("energy"))


def landmark_errors(flow: DataFrame, landmarks: DataFrame, size: dict[str, int], spacing: dict[str, float]) -> DataFrame:
    """Distance in millimetres of each landmark (id, fixed x, y, z and moving mx, my, mz) after the flow, which is read by
    linear interpolation with the nearest cell beyond the edges."""
    corners = landmarks
    for a in AXES:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(size[a] - 1)), F.col(f"m{a}").cast("double")))
        corners = corners.withColumn(f"_{a}", at).withColumn(f"c{a}", F.explode(F.array(F.floor(f"_{a}"), F.floor(f"_{a}") + 1)))
        corners = corners.withColumn(f"w{a}", 1 - F.abs(F.col(f"_{a}") - F.col(f"c{a}"))).where(F.col(f"w{a}") > 0)
    read = corners.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), (F.col("wx") * F.col("wy") * F.col("wz")).alias("w")).join(flow, AXES)
    moved = read.groupBy("id").agg(*[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"s{a}") for a in AXES])
    square = sum((F.pow((F.col(a) - F.col(f"m{a}") - F.col(f"s{a}")) * spacing[a], F.lit(2.0)) for a in AXES), F.lit(0.0))
    return landmarks.join(moved, "id").select("id", F.sqrt(square).alias("error"))


def class_overlap(rows: DataFrame, predicted: str, actual: str, classes: int, smooth: float = 1e-5) -> DataFrame:
    """Dice of each class but 0, also of those that no cell has, and their mean (class null)."""
    p, t = F.col(predicted), F.col(actual)
    sums = [c for k in range(1, classes) for c in (F.count_if((p == k) & (t == k)).alias(f"i{k}"), (F.count_if(p == k) + F.count_if(t == k)).alias(f"s{k}"))]
    dice = F.array(*[F.struct(F.lit(k).alias("class"), ((2.0 * F.col(f"i{k}") + smooth) / (F.col(f"s{k}") + smooth)).alias("dice")) for k in range(1, classes)])
    each = rows.agg(*sums).select(F.explode(dice).alias("x")).select("x.*")
    return each.unionByName(each.agg(F.avg("dice").alias("dice")).withColumn("class", F.lit(None).cast("int")))


def taps(spark: SparkSession, places: list[float], size: int) -> DataFrame:
    """For each place along an axis (out) the cells it is read from and their weights, the edge's cell beyond the edge."""
    rows: dict[tuple[int, int], float] = {}
    for out, at in enumerate(places):
        low = int(at // 1)
        for cell, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            key = out, min(max(cell, 0), size - 1)
            rows[key] = rows.get(key, 0.0) + w
    return spark.createDataFrame([(o, c, w) for (o, c), w in rows.items() if w], "out int, cell int, w double")


def resampled(cells: DataFrame, axis: str, places: list[float], size: int) -> DataFrame:
    """The volume read at the given places of one axis, by linear interpolation: each cell goes to the places it has a
    weight for, through a broadcast table that is as long as the axis."""
    others = [a for a in AXES if a != axis]
    t = F.broadcast(taps(cells.sparkSession, places, size))
    spread = cells.join(t, F.col(axis) == F.col("cell"))
    return spread.groupBy(*others, F.col("out").alias(axis)).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def resampled_to(cells: DataFrame, size: dict[str, int], target: dict[str, int]) -> DataFrame:
    """The volume in another number of cells, with centres of cells half a cell from the edges."""
    for a in AXES:
        if target[a] != size[a]:
            scale = size[a] / target[a]
            cells = resampled(cells, a, [(k + 0.5) * scale - 0.5 for k in range(target[a])], size[a])
    return cells.select(*AXES, "v")


def size_for_spacing(size: dict[str, int], spacing: dict[str, float], target: dict[str, float]) -> dict[str, int]:
    """How many cells of the target spacing the volume has, rounded half up, one at least."""
    return {a: max(1, int(size[a] * spacing[a] / target[a] + 0.5)) for a in AXES}


def even_places(positions: list[float], step: float) -> list[float]:
    """Fractional slice numbers at even steps from the first of the rising positions to the last."""
    count, out, i = max(1, -int(-(positions[-1] - positions[0]) // step)), [], 0
    for k in range(count):
        at = positions[0] + k * step
        while i < len(positions) - 2 and positions[i + 1] <= at:
            i += 1
        gap = positions[i + 1] - positions[i] if len(positions) > 1 else 0.0
        out.append(i + ((at - positions[i]) / gap if abs(gap) > 1e-6 else 0.0))
    return out


def ball(radius: int) -> list[tuple[int, int, int]]:
    """Offsets (dx, dy, dz) of the cells of a ball, to half a squared cell beyond the radius."""
    span = range(-radius, radius + 1)
    return [(x, y, z) for x, y, z in product(span, span, span) if x * x + y * y + z * z <= radius * radius + 0.5]


def shifted(mask: DataFrame, offsets: list[tuple[int, int, int]], size: dict[str, int]) -> DataFrame:
    """Each cell of the mask moved by each offset, inside the volume."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(AXES, o, strict=True)]) for o in offsets])).alias("d")
    moved = mask.select(*AXES, moves).select(*[(F.col(a) + F.col(f"d.{a}")).alias(a) for a in AXES])
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(0, size[a] - 1)
    return moved.where(inside)


def dilated(mask: DataFrame, radius: int, size: dict[str, int]) -> DataFrame:
    return shifted(mask, ball(radius), size).distinct()


def eroded(mask: DataFrame, radius: int, size: dict[str, int]) -> DataFrame:
    """Cells whose whole ball is in the mask; what lies outside the volume isn't."""
    offsets = ball(radius)
    return shifted(mask, offsets, size).groupBy(*AXES).count().where(F.col("count") == len(offsets)).select(*AXES)


def in_circle(cx: float, cy: float, radius: float) -> Column:
    return (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= radius * radius


def by_slice(mask: DataFrame, index: Column) -> DataFrame:
    """Cells of a mask with the label of their component of face neighbours inside their own slice (z)."""
    rows = mask.select(*AXES, index.cast("long").alias("id"))
    w, h = line("x"), line("y")
    links = [F.when(F.lead(a).over(o) == F.col(a) + 1, F.struct(F.col("id").alias("a"), F.lead("id").over(o).alias("b"))) for a, o in (("x", w), ("y", h))]
    edges = rows.select(F.array(*links).alias("links")).select(F.explode("links").alias("e")).where("e is not null").select("e.*")
    found = rooted(edges).select("id", "root")
    return rows.join(found, "id", "left").select(*AXES, "id", F.coalesce("root", "id").alias("label"))


def largest_of_each_slice(mask: DataFrame, index: Column) -> DataFrame:
    """The cells of each slice's largest component, of equals the first in scan order."""
    labelled = by_slice(mask, index)
    best = labelled.groupBy("z", "label").agg(F.count("*").alias("n")).groupBy("z").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labelled.join(best, ["z", "label"], "left_semi").select(*AXES)


def body(cells: DataFrame, size: dict[str, int], level: float, circle: tuple[float, float, float], index: Column) -> DataFrame:
    """Cells of the body: over the level inside the field of view, each slice's largest component, its holes filled."""
    mask = largest_of_each_slice(cells.where((F.col("v") > level) & in_circle(*circle)), index)
    empty = by_slice(cells.select(*AXES).join(mask, AXES, "left_anti"), index)
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == size["x"] - 1) | (F.col("y") == size["y"] - 1)
    outside = empty.where(border).select("label").distinct()
    return mask.unionByName(empty.join(outside, "label", "left_anti").select(*AXES))


def without_table(cells: DataFrame, size: dict[str, int], level: float, circle: tuple[float, float, float], index: Column, blank: float) -> DataFrame:
    """The volume with everything outside the body blank."""
    inside = body(cells, size, level, circle, index).withColumn("_in", F.lit(True))
    return cells.join(inside, AXES, "left").select(*AXES, F.when(F.col("_in"), F.col("v")).otherwise(F.lit(blank)).alias("v"))


def lungs(cells: DataFrame, size: dict[str, int], level: float, index: Column) -> DataFrame:
    """Cells under the level that no way of such cells leads from to the first or last slice or row, and their face neighbours."""
    low = components(cells.where(F.col("v") < level), AXES, index, 6)
    edge = (F.col("z") == 0) | (F.col("z") == size["z"] - 1) | (F.col("y") == 0) | (F.col("y") == size["y"] - 1)
    inner = low.join(low.where(edge).select("label").distinct(), "label", "left_anti").select(*AXES)
    return inner.unionByName(shifted(inner, FACES, size)).distinct()


def filled_slices(cells: DataFrame, level: float = 0.01, share: float = 0.01) -> DataFrame:
    """Cells of the slices that have a share of cells over the level at least."""
    kept = cells.groupBy("z").agg(F.avg((F.col("v") > level).cast("double")).alias("share")).where(F.col("share") >= share).select("z")
    return cells.join(kept, "z", "left_semi")


def transposed(cells: DataFrame, order: str) -> DataFrame:
    """The volume with its axes renamed: order "zyx" makes the old z the new x, and so on."""
    return cells.select(*[F.col(old).alias(new) for new, old in zip(AXES, order, strict=True)], "v")


def padded(cells: DataFrame, size: dict[str, int], target: dict[str, int], value: float = 0.0) -> DataFrame:
    """The volume with cells of one value after its ends, up to the target size."""
    frame = cells.sparkSession.range(target["x"] * target["y"] * target["z"])
    i = F.col("id")
    frame = frame.select((i % target["x"]).cast("int").alias("x"), (F.floor(i / target["x"]) % target["y"]).cast("int").alias("y"), F.floor(i / (target["x"] * target["y"])).cast("int").alias("z"))
    return frame.join(cells, AXES, "left").select(*AXES, F.coalesce("v", F.lit(value)).alias("v"))


def flattened(cells: DataFrame, size: dict[str, int]) -> DataFrame:
    """Place in scan order and value."""
    return cells.select(((F.col("z").cast("long") * size["y"] + F.col("y")) * size["x"] + F.col("x")).alias("place"), "v")


def bounded_statistics(points: DataFrame, cells: DataFrame, cell_volume: float) -> DataFrame:
    """Mean, deviation, least and largest value of the points inside the volume; the volume counts all points."""
    total = points.agg((F.count("*") * F.lit(cell_volume)).alias("volume"))
    v = F.col("v")
    inside = points.join(cells, AXES).agg(F.avg(v).alias("mean"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))).alias("sd"), F.min(v).alias("least"), F.max(v).alias("largest"))
    return inside.join(F.broadcast(total))


def every_nth(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """Every n-th row by place (a column that numbers all rows from 0), n the rows by `most` rounded down, 1 at least."""
    step = max(1, rows.count() // most)
    return rows.where(F.pmod(order, F.lit(step)) == 0)


def random_places(spark: SparkSession, count: int, size: dict[str, int], seed: int = 42) -> DataFrame:
    """Uniform places 1 .. size - 1 along each axis, the same for the same seed."""
    pick = lambda k, n: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(max(1, n - 1))) + 1).cast("int")
    return spark.range(count).select("id", *[pick(k, size[a]).alias(a) for k, a in enumerate(AXES)])
