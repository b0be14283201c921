"""Grids in long form: one row a cell, with integer coordinate columns and a value.

Statistics of regions, histograms, thresholds, agreement of masks, profiles and stencils, all as sums by key, joins of
shifted keys or windows along one axis, so that a grid of any size stays distributed by row or block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles


def as_grid(rows: DataFrame, y: str, values: str) -> DataFrame:
    """Rows of an array column as cells (y, x, v)."""
    return rows.select(F.col(y).alias("y"), F.posexplode(values).alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("v"))


# --- statistics of regions -------------------------------------------------------------------------------------------


def region_statistics(cells: DataFrame, by: list[str] = [], v: str = "v", index: str = "idx", cell_volume: float = 1.0, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:  # noqa: B006
    """count, sum, mean, population deviation, truncated extremes, where they first occur, bounding box and volume."""
    x = F.col(v)
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    mean = F.avg(x)
    return cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - mean * mean)).alias("sd"),
        F.min(whole).alias("lowest"), F.max(whole).alias("highest"),
        F.min_by(index, F.struct(whole, index)).alias("first_lowest"), F.max_by(index, F.struct(whole, -F.col(index))).alias("first_highest"),
        *[f(a).alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))],
        (F.count("*") * cell_volume).alias("volume"),
    )


def labelled_statistics(cells: DataFrame, labels: DataFrame, label: str = "label", **options) -> DataFrame:
    """region_statistics of each wanted label; labels without cells are given with n = 0."""
    found = region_statistics(cells.join(labels.select(label).distinct(), label, "left_semi"), [label], **options)
    return labels.select(label).distinct().join(found, label, "left").fillna(0, ["n"])


def region_shape(cells: DataFrame, by: list[str]) -> DataFrame:
    """area, centroid, box, axes of the ellipse of equal second moments (4 * sqrt of eigenvalues), eccentricity, and area over box area."""
    m = cells.groupBy(*by).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy"))
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, F.lit(2.0)) + F.col("_xy") * F.col("_xy"))
    m = m.withColumns({"_l1": half + root, "_l2": F.greatest(half - root, F.lit(0.0))})
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return m.withColumns({"major": 4 * F.sqrt("_l1"), "minor": 4 * F.sqrt("_l2"), "eccentricity": F.when(F.col("_l1") > 0, F.sqrt(1 - F.col("_l2") / F.col("_l1"))).otherwise(0.0), "solidity": F.col("area") / box}).drop("_xx", "_yy", "_xy", "_l1", "_l2")


def ball_offsets(spark, radius: tuple[float, ...]) -> DataFrame:
    """Integer offsets inside a ball of 1 mm-scaled radii, one for each axis (dx, dy[, dz])."""
    out = spark.range(1).select()
    inside = F.lit(0.0)
    for name, r in zip(("dx", "dy", "dz"), radius, strict=False):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(-int(r)), F.lit(int(r)))))
        inside = inside + F.pow(F.col(name) / r, F.lit(2.0))
    return out.where(inside <= 1)


def peak_of_ball_means(cells: DataFrame, centres: DataFrame, offsets: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The largest mean over a ball round any centre; balls are cut by the grid, not by the region. The offsets' number is fixed by the radius, so they are broadcast."""
    moved = centres.join(F.broadcast(offsets)).select(*[F.col(a).alias(f"c{a}") for a in axes], *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in axes])
    means = moved.join(cells, list(axes)).groupBy(*[f"c{a}" for a in axes]).agg(F.avg("v").alias("mean"))
    return means.agg(F.max("mean").alias("peak"))


def projection(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Maximum along all other axes."""
    return cells.groupBy(*axes).agg(F.max("v").alias("v"))


def profile(cells: DataFrame, axis: str, threshold: float) -> DataFrame:
    """How many cells reach the threshold at each place of an axis."""
    return cells.groupBy(axis).agg(F.count_if(F.col("v") >= threshold).alias("n"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; 0 where it isn't defined."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def best_match(profiles: DataFrame, target: DataFrame, key: str, at: str) -> DataFrame:
    """Correlation of each key's profile (key, at, v) with the target's (at, v)."""
    joined = profiles.join(target.select(at, F.col("v").alias("_t")), at)
    return joined.groupBy(key).agg(correlation(F.col("v"), F.col("_t")).alias("ncc"))


def parabola(rows: DataFrame, x: str, y: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Least-squares c0 + c1 x + c2 x^2; a constant for fewer than three rows."""
    s = {f"s{k}": F.sum(F.pow(x, F.lit(float(k)))) for k in range(5)} | {f"t{k}": F.sum(F.pow(x, F.lit(float(k))) * F.col(y)) for k in range(3)}
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("_m"), *[c.cast("double").alias(k) for k, c in s.items()])
    c = {k: F.col(k) for k in s}
    det3 = lambda p: p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])
    base = [[c[f"s{i + j}"] for j in range(3)] for i in range(3)]
    whole = det3(base)
    out = {}
    for k in range(3):
        swapped = [[c[f"t{i}"] if j == k else base[i][j] for j in range(3)] for i in range(3)]
        out[f"c{k}"] = F.when((F.col("n") >= 3) & (F.abs(whole) > 1e-12), det3(swapped) / whole).otherwise(F.col("_m") if k == 0 else F.lit(0.0))
    return m.withColumns(out).select(*by, "n", *out)


# --- histograms and thresholds ----------------------------------------------------------------------------------------


def histogram(rows: DataFrame, v: Column, low: float, high: float, bins: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts of bins 0 .. bins-1 of [low, high], values beyond in the outer ones."""
    at = F.least(F.greatest(F.floor((v - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.where(v.isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def full_histogram(rows: DataFrame, v: Column, low: float, high: float, bins: int) -> DataFrame:
    """The same with empty bins."""
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(histogram(rows, v, low, high, bins), "bin", "left").fillna(0, ["n"])


def _running(first: str = "bin") -> Window:
    return Window.orderBy(first).rowsBetween(Window.unboundedPreceding, 0)


def otsu(counts: DataFrame) -> DataFrame:
    """The bin that best parts a histogram (bin, n) in two: largest variance between classes, first of equals. The table has one row a bin, so one task sorts it."""
    w = _running()
    rows = counts.withColumns({"_w": F.sum("n").over(w), "_m": F.sum(F.col("n") * F.col("bin")).over(w)})
    all_ = counts.agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("bin")).alias("_s"))
    rows = rows.join(F.broadcast(all_)).where("_w > 0 and _w < _n")
    between = F.pow(F.col("_m") * F.col("_n") - F.col("_s") * F.col("_w"), F.lit(2.0)) / (F.col("_w").cast("double") * (F.col("_n") - F.col("_w")))
    return rows.withColumn("between", between).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold"))


def reaching_bin(counts: DataFrame, share: float) -> DataFrame:
    """The first bin whose running share of all counts is over `share`."""
    rows = counts.withColumns({"_c": F.sum("n").over(_running()), "_n": F.sum("n").over(Window.partitionBy())})
    return rows.where(F.col("_c") > share * F.col("_n")).agg(F.min("bin").alias("bin"))


def joint_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies of two binned columns, their mutual information and (ha + hb) / (hab + 1e-10)."""
    joint = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").cast("double").alias("t"))
    entropy = lambda t, name: t.join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(name))
    ha, hb, hab = entropy(joint.groupBy(a).agg(F.sum("n").alias("n")), "ha"), entropy(joint.groupBy(b).agg(F.sum("n").alias("n")), "hb"), entropy(joint, "hab")
    return ha.join(hb).join(hab).withColumns({"mi": F.col("ha") + F.col("hb") - F.col("hab"), "nmi": (F.col("ha") + F.col("hb")) / (F.col("hab") + 1e-10)})


# --- normalisation ------------------------------------------------------------------------------------------------------


def normalise(rows: DataFrame, v: str, how: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds `z`: 'minmax' or 'zscore' by group (population deviation); flat groups get 0. Each group's two numbers come
    from one sum by key and are joined back; rows without a group's key have no z."""
    ends = (F.min(v), F.max(v) - F.min(v)) if how == "minmax" else (F.avg(v), F.stddev_pop(v))
    bounds = rows.groupBy(*by).agg(ends[0].alias("_low"), ends[1].alias("_width"))
    joined = rows.join(bounds, by, "left") if by else rows.join(F.broadcast(bounds))
    z = F.when(F.col("_width") > 1e-8, (F.col(v) - F.col("_low")) / F.col("_width")).otherwise(0.0)
    return joined.withColumn("z", z).select(*rows.columns, "z")


def clip_percentiles(rows: DataFrame, v: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Adds `z`: the value cut to two exact percentiles and scaled to [0, 1]."""
    ends = quantiles(rows, v, [low, high]).toDF("_lo", "_hi")
    cut = F.least(F.greatest(F.col(v), F.col("_lo")), F.col("_hi"))
    return rows.join(F.broadcast(ends)).withColumn("z", F.when(F.col("_hi") - F.col("_lo") > 1e-8, (cut - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def window_level(v: Column, centre: float, width: float, top: float = 1.0) -> Column:
    """Values of [centre - width/2, centre + width/2] scaled to [0, top], the rest cut."""
    return F.least(F.greatest((v - (centre - width / 2)) / width, F.lit(0.0)), F.lit(1.0)) * top


# --- agreement of masks and images ----------------------------------------------------------------------------------------


def agreement(rows: DataFrame, predicted: Column, actual: Column, by: list[str] = [], smooth: float = 1e-5) -> DataFrame:  # noqa: B006
    """Dice, IoU (both 1 if both are empty), smoothed Dice, sensitivity and specificity of two boolean columns."""
    c = rows.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "dice": F.when(tp + fp + fn == 0, 1.0).otherwise(2.0 * tp / (2 * tp + fp + fn)), "iou": F.when(tp + fp + fn == 0, 1.0).otherwise(tp / (tp + fp + fn)),
        "dice_smooth": (2.0 * tp + smooth) / (2 * tp + fp + fn + smooth), "sensitivity": tp / (tp + fn + 1e-8), "specificity": tn / (tn + fp + 1e-8),
    })


def class_agreement(rows: DataFrame, predicted: str, actual: str, skip: tuple[int, ...] = ()) -> DataFrame:
    """Dice and IoU of each class of two label columns, by one pass of sums."""
    each = rows.select(F.explode(F.array_distinct(F.array(predicted, actual))).alias("class"), predicted, actual)
    return agreement(each.where(~F.col("class").isin(*skip)) if skip else each, F.col(predicted) == F.col("class"), F.col(actual) == F.col("class"), ["class"]).select("class", "tp", "fp", "fn", "dice", "iou")


def error_metrics(rows: DataFrame, a: Column, b: Column, peak: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """mse, psnr (infinite without error) and correlation."""
    out = rows.groupBy(*by).agg(F.avg(F.pow(a - b, F.lit(2.0))).alias("mse"), correlation(a, b).alias("ncc"))
    return out.withColumn("psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / F.col("mse"))))


# --- stencils --------------------------------------------------------------------------------------------------------------


def differences(cells: DataFrame) -> DataFrame:
    """Central differences gx, gy (null at the border) and their length g."""
    along = lambda axis, other: Window.partitionBy(other).orderBy(axis)
    half = lambda w: (F.lead("v").over(w) - F.lag("v").over(w)) / 2
    out = cells.withColumns({"gx": half(along("x", "y")), "gy": half(along("y", "x"))})
    return out.withColumn("g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def box_mean(cells: DataFrame, radius: int) -> DataFrame:
    """Mean of the cells within `radius` along both axes, one axis after the other; what lies outside counts as zero."""
    out, size = cells, 2 * radius + 1
    for axis, other in (("x", "y"), ("y", "x")):
        out = out.withColumn("v", F.sum("v").over(Window.partitionBy(other).orderBy(axis).rangeBetween(-radius, radius)) / size)
    return out


def weighted_filter(cells: DataFrame, weights: list[float], axis: str, other: str) -> DataFrame:
    """Weighted sum along an axis with the border's value repeated outside; weights are centred."""
    w = Window.partitionBy(other).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = len(weights) // 2
    total = F.lit(0.0)
    for k, weight in enumerate(weights):
        moved = F.lag("v", r - k).over(w) if k < r else F.lead("v", k - r).over(w)
        total = total + weight * F.coalesce(moved, (F.first("v") if k < r else F.last("v")).over(whole))
    return cells.withColumn("v", total)


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every cell's key paired with its neighbours' values: an equi-join of shifted keys."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])).alias("d")
    moved = cells.select("x", "y", "v", shifts).select((F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("v").alias("nv"))
    return cells.join(moved, ["x", "y"])


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def erode(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Cells (x, y) of a sparse mask whose four neighbours are all set; the outermost ring is never set."""
    near = neighbours(mask.select("x", "y", F.lit(1).alias("v")), FOUR).groupBy("x", "y").agg(F.count("*").alias("_n")).where("_n = 4")
    return near.where((F.col("x") > 0) & (F.col("x") < width - 1) & (F.col("y") > 0) & (F.col("y") < height - 1)).select("x", "y")


def dilate(mask: DataFrame, width: int, height: int) -> DataFrame:
    """The mask and its four neighbours; growth never reaches the outermost ring."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in FOUR])).alias("d")
    grown = mask.select((F.col("x")).alias("x0"), F.col("y").alias("y0"), shifts).select((F.col("x0") + F.col("d.dx")).alias("x"), (F.col("y0") + F.col("d.dy")).alias("y"))
    inside = (F.col("x") > 0) & (F.col("x") < width - 1) & (F.col("y") > 0) & (F.col("y") < height - 1)
    return mask.select("x", "y").union(grown.where(inside)).distinct()


def square_cases(cells: DataFrame, level: float) -> DataFrame:
    """The marching-squares case (0-15) of each 2 x 2 square: bits 1, 2, 4, 8 for the corners (0,0), (1,0), (1,1), (0,1)."""
    up = Window.partitionBy("x").orderBy("y")
    right = Window.partitionBy("y").orderBy("x")
    in_ = cells.withColumn("b", (F.col("v") >= level).cast("int"))
    in_ = in_.withColumn("b01", F.lead("b").over(up))
    in_ = in_.withColumns({"b10": F.lead("b").over(right), "b11": F.lead("b01").over(right)})
    return in_.where("b10 is not null and b01 is not null").select("x", "y", (F.col("b") + 2 * F.col("b10") + 4 * F.col("b11") + 8 * F.col("b01")).alias("case"))
