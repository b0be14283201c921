"""Contours, polygons, surfaces and point sets as tables: expressions over sides and corners, joins along one axis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import rooted
from .images import square_cases
from .meshes import corners


def _cut(case: int) -> list[tuple[int, int]]:
    """The sides of a square (k lies between corners k and k + 1) that each contour segment of a case joins. Where all four
    sides are cut, each corner inside is cut off on its own."""
    inside = [case >> k & 1 for k in range(4)]
    sides = [k for k in range(4) if inside[k] != inside[(k + 1) % 4]]
    return [tuple(sorted(((k - 1) % 4, k))) for k in range(4) if inside[k]] if len(sides) == 4 else [tuple(sides)] if sides else []


def contour_segments(cells: DataFrame, level: float) -> DataFrame:
    """Segments x0, y0, x1, y1 of the contours round cells at or over the level, between the middles of squares' sides."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    middle = [(x + 0.5, y), (x + 1.0, y + 0.5), (x + 0.5, y + 1.0), (x, y + 0.5)]
    part = lambda s: F.struct(*[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (*middle[s[0]], *middle[s[1]]), strict=True)])
    by_case = F.when(F.col("case") == -1, F.array(part((0, 1))))
    for case in range(1, 15):
        by_case = by_case.when(F.col("case") == case, F.array(*map(part, _cut(case))))
    return square_cases(cells, level).where(~F.col("case").isin(0, 15)).select(F.explode(by_case).alias("s")).select("s.*")


def contour_loops(segments: DataFrame) -> DataFrame:
    """Segments with the loop they belong to (`loop`, its least point) and whether it is closed: segments that share an
    end are linked, and components of links are loops. Coordinates are halves from 0 to a million."""
    point = lambda x, y: (F.col(x) * 2).cast("long") * (1 << 21) + (F.col(y) * 2).cast("long")
    rows = segments.select("*", point("x0", "y0").alias("a"), point("x1", "y1").alias("b"))
    ends = rows.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    named = ends.join(rooted(rows.select("a", "b")), "id").select("id", F.col("root").alias("loop"), (F.col("n") == 1).alias("loose"))
    open_ = named.groupBy("loop").agg((F.count_if("loose") == 0).alias("closed"))
    return rows.join(named.select(F.col("id").alias("a"), "loop"), "a").join(open_, "loop").drop("a", "b")


def sides(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Sides x0, y0, x1, y1 of closed polygons."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.coalesce(F.lead(a).over(w), F.first(a).over(whole)).alias(f"{a}1") for a in ("x", "y")]
    return points.select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"), *after)


def areas(polygon_sides: DataFrame, by: list[str]) -> DataFrame:
    """Signed area (holes are negative) and length of the outline."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0)))
    return polygon_sides.groupBy(*by).agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("outline"))


def crossings(polygon_sides: DataFrame, by: list[str], step: float, offset: float = 0.0) -> DataFrame:
    """Where the lines y = offset + row * step cross the polygons' sides: by, row, x. A side has its lower end, not its upper."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil((low - offset) / step), F.ceil((high - offset) / step) - 1
    rows = polygon_sides.where(last >= first).withColumn("row", F.explode(F.sequence(first, last)))
    at = F.col("row") * step + offset
    return rows.select(*by, "row", (F.col("x0") + (at - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("x"))


def spans(polygon_sides: DataFrame, by: list[str], step: float, offset: float = 0.0) -> DataFrame:
    """Lines of an infill or of a raster: by, row and the ends x0 and x1 of each stretch inside the polygons (even-odd)."""
    w = Window.partitionBy(*by, "row").orderBy("x")
    pairs = crossings(polygon_sides, by, step, offset).select(*by, "row", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.row_number().over(w).alias("k"))
    return pairs.where((F.col("k") % 2 == 1) & F.col("x1").isNotNull()).drop("k")


def inside_cells(polygon_sides: DataFrame, by: list[str]) -> DataFrame:
    """Cells (x, y) whose centre lies inside the polygons."""
    s = spans(polygon_sides, by, 1.0, 0.5).withColumn("first", F.ceil(F.col("x0") - 0.5)).withColumn("last", F.ceil(F.col("x1") - 0.5) - 1)
    return s.where("last >= first").select(*by, F.col("row").alias("y"), F.explode(F.sequence("first", "last")).alias("x"))


def normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Unit normal of each vertex: the sum of its triangles' normals, larger ones counting more."""
    t = corners(vertices, triangles)
    u, w = ([F.col(c + a) - F.col("a" + a) for a in "xyz"] for c in "bc")
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    each = t.select(F.explode(F.array("a", "b", "c")).alias("vertex"), *[c.alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)])
    total = each.groupBy("vertex").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)))
    return total.select("vertex", *[F.when(size > 0, F.col(f"n{a}") / size).otherwise(0.0).alias(f"n{a}") for a in "xyz"])


def boxed_cells(vertices: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """Cells (i, j, k) that the bounding box of any triangle touches."""
    t = corners(vertices, triangles)
    for n, a in zip("ijk", "xyz", strict=True):
        names = [c + a for c in "abc"]
        t = t.withColumn(n, F.explode(F.sequence(F.floor(F.least(*names) / cell), F.floor(F.greatest(*names) / cell))))
    return t.select("i", "j", "k").distinct()


def sweep_diameter(points: DataFrame, axes: list[str], by: list[str], steps: int = 3) -> DataFrame:
    """A long distance between points of a key: from its first point (by id) to the farthest, and on from there. A lower
    bound of the diameter; each step is one aggregation and a join of one row a key."""
    at = points.groupBy(*by).agg(F.min_by(F.struct(*axes), "id").alias("from"))
    for _ in range(steps):
        square = sum((F.pow(F.col(a) - F.col(f"from.{a}"), F.lit(2.0)) for a in axes), F.lit(0.0))
        far = points.join(at.select(*by, "from"), by).groupBy(*by).agg(F.max_by(F.struct(*axes), F.struct(square, -F.col("id"))).alias("from"), F.sqrt(F.max(square)).alias("diameter"))
        at = far
    return at.select(*by, "diameter")


def hessian_invariants(cells: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Eigenvalues (rising) of the second differences of inner cells, by the closed form of symmetric matrices."""
    line = lambda a: Window.partitionBy(*[b for b in axes if b != a]).orderBy(a)
    x, y, z = axes
    h = cells.withColumns({f"d{a}{a}": F.lead("v").over(line(a)) + F.lag("v").over(line(a)) - 2 * F.col("v") for a in axes} | {f"d{a}": (F.lead("v").over(line(a)) - F.lag("v").over(line(a))) / 2 for a in (x, y)})
    h = h.withColumns({f"d{a}{b}": (F.lead(f"d{a}").over(line(b)) - F.lag(f"d{a}").over(line(b))) / 2 for a, b in ((x, y), (x, z), (y, z))})
    a, b, c, d, e, f = (F.col(f"d{n}") for n in (x + x, y + y, z + z, x + y, x + z, y + z))
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    large, small = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2.0943951023931953)
    flat = p <= 1e-30
    inner = h.where(F.col(f"d{x}{y}").isNotNull() & F.col(f"d{x}{z}").isNotNull() & F.col(f"d{y}{z}").isNotNull() & a.isNotNull() & b.isNotNull() & c.isNotNull())
    return inner.select(*axes, F.when(flat, q).otherwise(small).alias("l1"), F.when(flat, q).otherwise(3 * q - large - small).alias("l2"), F.when(flat, q).otherwise(large).alias("l3"))


def two_stage(cells: DataFrame, factor: int, coarse: Callable[[Column], Column], fine: Callable[[Column], Column]) -> DataFrame:
    """Cells that pass `fine` in the blocks of factor x factor cells whose mean passes `coarse`."""
    blocked = cells.withColumns({"bx": F.floor(F.col("x") / factor), "by": F.floor(F.col("y") / factor)})
    wanted = blocked.groupBy("bx", "by").agg(F.avg("v").alias("m")).where(coarse(F.col("m"))).select("bx", "by")
    return blocked.join(wanted, ["bx", "by"], "left_semi").where(fine(F.col("v"))).select("x", "y", "v")


def grown_statistics(region: DataFrame, cells: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of a grown region and their mean, least and largest value."""
    return region.join(cells, axes).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("largest"))


def shares_by_bin(cells: DataFrame, low: float, high: float, bins: int, label: str) -> DataFrame:
    """For each label the share of its cells by bin; the last bin has the highest value alone."""
    at = F.floor((F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) - low) / (high - low) * (bins - 1)).cast("int")
    counts = cells.groupBy(label, at.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), label).select(label, "bin", (F.col("n") / F.col("total")).alias("share"))
