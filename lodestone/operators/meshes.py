"""Triangle meshes as tables: triangles (tri, a, b, c) over vertices (vertex, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import range_join


def height_field(spark: SparkSession, width: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of a wavy sheet, for tests and examples."""
    v = spark.range(width * depth).select(F.col("id").alias("vertex"), (F.col("id") % width).cast("double").alias("x"), F.floor(F.col("id") / width).cast("double").alias("y"))
    v = v.withColumn("z", (F.pmod(F.col("vertex") * 7, F.lit(11)) / 2.0).cast("double"))
    squares = v.where((F.col("x") < width - 1) & (F.col("y") < depth - 1)).select("vertex")
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"), (F.col("vertex") + width).alias("c")), F.struct(F.lit(1).alias("k"), (F.col("vertex") + 1).alias("a"), (F.col("vertex") + width + 1).alias("b"), (F.col("vertex") + width).alias("c"))))
    t = squares.select("vertex", two.alias("t")).select((F.col("vertex") * 2 + F.col("t.k")).alias("tri"), "t.a", "t.b", "t.c")
    return v, t


def edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges (p < q) and how many triangles have each."""
    each = F.explode(F.array(*[F.array_sort(F.array(p, q)) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    return triangles.select(each).select(F.col("e")[0].alias("p"), F.col("e")[1].alias("q")).groupBy("p", "q").agg(F.count("*").alias("n"))


def edge_report(triangles: DataFrame) -> DataFrame:
    """Edges in all, on the boundary (one triangle) and non-manifold (more than two)."""
    return edges(triangles).agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold"))


def weld(vertices: DataFrame, triangles: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of one grid cell become the one with the smallest number; triangles that lose a corner go."""
    keys = [F.floor(F.col(a) / cell).alias(f"k{a}") for a in "xyz"]
    v = vertices.select("vertex", "x", "y", "z", *keys)
    first = v.groupBy("kx", "ky", "kz").agg(F.min("vertex").alias("to"))
    names = v.join(first, ["kx", "ky", "kz"]).select("vertex", "to")
    out = triangles
    for c in "abc":
        out = out.join(names.select(F.col("vertex").alias(c), F.col("to").alias(f"n{c}")), c).drop(c).withColumnRenamed(f"n{c}", c)
    return vertices.join(names.where("vertex = to").select("vertex"), "vertex", "left_semi"), out.where("a <> b and b <> c and a <> c").select("tri", "a", "b", "c")


def smooth(vertices: DataFrame, triangles: DataFrame, share: float) -> DataFrame:
    """One Laplacian step: each vertex moves by `share` towards the mean of its neighbours (a negative share is Taubin's second step)."""
    e = edges(triangles)
    both = e.select("p", "q").union(e.select(F.col("q").alias("p"), F.col("p").alias("q")))
    means = both.join(vertices.withColumnRenamed("vertex", "q"), "q").groupBy("p").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    joined = vertices.join(means.withColumnRenamed("p", "vertex"), "vertex", "left")
    return joined.select("vertex", *[(F.col(a) + share * (F.coalesce(f"m{a}", a) - F.col(a))).alias(a) for a in "xyz"])


def taubin(vertices: DataFrame, triangles: DataFrame, rounds: int = 1, out: float = 0.5, back: float = -0.53) -> DataFrame:
    for _ in range(rounds):
        vertices = smooth(smooth(vertices, triangles, out), triangles, back)
    return vertices


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners: ax, ay, az, bx, ..."""
    out = triangles
    for c in "abc":
        out = out.join(vertices.select(F.col("vertex").alias(c), *[F.col(a).alias(c + a) for a in "xyz"]), c)
    return out


def measures(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area, signed volume and bounding box."""
    t = corners(vertices, triangles)
    u, w = ([F.col(c + a) - F.col("a" + a) for a in "xyz"] for c in "bc")
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    volume = (F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6
    box = [f(g(*[c + a for c in "abc"])).alias(f"{a}_{name}") for a in "xyz" for f, g, name in ((F.min, F.least, "min"), (F.max, F.greatest, "max"))]
    return t.agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"), *box)


def slices(vertices: DataFrame, triangles: DataFrame, heights: DataFrame, width: float) -> DataFrame:
    """Segments (z, tri, x0, y0, x1, y1) where planes cut triangles: a range join of heights and the triangles' extents."""
    t = corners(vertices, triangles).withColumns({"lo": F.least("az", "bz", "cz"), "hi": F.greatest("az", "bz", "cz")})
    met = range_join(heights.select("z"), t, "z", "lo", "hi", width)
    points = []
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        share = (F.col("z") - F.col(p + "z")) / (F.col(q + "z") - F.col(p + "z"))
        crosses = (F.col(p + "z") < F.col("z")) != (F.col(q + "z") < F.col("z"))
        points.append(F.when(crosses, F.struct(*[(F.col(p + a) + share * (F.col(q + a) - F.col(p + a))).alias(a) for a in "xy"])))
    found = F.filter(F.array(*points), lambda s: s.isNotNull())
    cut = met.select("z", "tri", found.alias("s")).where(F.size("s") == 2)
    return cut.select("z", "tri", F.col("s")[0]["x"].alias("x0"), F.col("s")[0]["y"].alias("y0"), F.col("s")[1]["x"].alias("x1"), F.col("s")[1]["y"].alias("y1"))


def layer_lengths(segments: DataFrame) -> DataFrame:
    """Segments and their whole length by layer."""
    d = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0)))
    return segments.groupBy("z").agg(F.count("*").alias("segments"), F.sum(d).alias("length"))


def extrusion(length, layer: float, width: float, filament: float):
    """Filament used for a path."""
    return length * (layer * width / (3.141592653589793 * (filament / 2) ** 2))
