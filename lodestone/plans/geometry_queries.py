"""Queries of contours, polygons, surfaces and point sets, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import connected as C  # noqa: N812
from ..operators import geometry as G  # noqa: N812
from ..operators import kernels, meshes
from ..operators import voxels as V  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _IMG, _r, image
from .tables import table
from .voxel_queries import _VOL, index, volume

W, D = 40, 30


def contours(spark, sf_dir):
    s = G.contour_segments(image(spark, sf_dir), 0.1)
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0)))
    return rounded(s.groupBy(F.floor(F.least("y0", "y1")).alias("y")).agg(F.count("*").alias("n"), F.sum(length).alias("length"), F.sum(F.col("x0") + F.col("x1")).alias("places")), 6)


def loops(spark, sf_dir):
    found = G.contour_loops(G.contour_segments(image(spark, sf_dir), 0.25)).groupBy("loop").agg(F.count("*").alias("segments"), F.first("closed").alias("closed"))
    return found.groupBy("segments", "closed").agg(F.count("*").alias("loops"))


def _polygons(spark, sf_dir):
    """A star of eight corners for each supplier."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("poly"), F.posexplode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (5, 2), (10, 0), (8, 5), (10, 10), (5, 8), (0, 10), (2, 5))])).alias("i", "p"))
    return s.select("poly", "i", (F.col("p.x") * (1 + F.col("poly") % 3) + F.col("poly") * 0.13).alias("x"), (F.col("p.y") * (1 + F.col("poly") % 2) - F.col("poly") * 0.07).alias("y"))


def polygon_areas(spark, sf_dir):
    return rounded(G.areas(G.sides(_polygons(spark, sf_dir), ["poly"], ["i"]), ["poly"]), 7)


def infill(spark, sf_dir):
    s = G.spans(G.sides(_polygons(spark, sf_dir), ["poly"], ["i"]), ["poly"], 1.3)
    return rounded(s.groupBy("poly").agg(F.count("*").alias("lines"), F.sum(F.col("x1") - F.col("x0")).alias("length")), 6)


def polygon_cells(spark, sf_dir):
    return G.inside_cells(G.sides(_polygons(spark, sf_dir), ["poly"], ["i"]), ["poly"]).groupBy("poly").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def vertex_normals(spark, sf_dir):
    return rounded(G.normals(*meshes.height_field(spark, W, D)), 8)


def taubin(spark, sf_dir):
    v, t = meshes.height_field(spark, W, D)
    return rounded(meshes.taubin(v, t), 8)


def boxed(spark, sf_dir):
    return G.boxed_cells(*meshes.height_field(spark, W, D), 1.5)


def diameters(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), (F.col("p_partkey") % 40).cast("double").alias("z"))
    return rounded(G.sweep_diameter(p, V.AXES, ["p_brand"]), 7)


def hessian(spark, sf_dir):
    h = G.hessian_invariants(volume(spark, sf_dir))
    a, b, c = F.col("l1"), F.col("l2"), F.col("l3")
    return rounded(h.groupBy("z").agg(F.sum(a + b + c).alias("trace"), F.sum(a * b * c).alias("det"), F.sum(a * a + b * b + c * c).alias("squares"), F.count_if((a <= b + 1e-9) & (b <= c + 1e-9)).alias("rising")), 6)


def staged(spark, sf_dir):
    return rounded(G.two_stage(image(spark, sf_dir), 8, lambda m: m > 0.0, lambda v: v > 0.2), 8)


def grown(spark, sf_dir):
    cells = image(spark, sf_dir)
    region = C.threshold_region(cells, {"x": 12, "y": 40}, None, -0.12, ["x", "y"], F.col("y") * 64 + F.col("x"), 8).select("x", "y")
    return rounded(G.grown_statistics(region, cells, ["x", "y"]), 8)


def binned(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return rounded(G.shares_by_bin(e, -0.4, 0.4, 33, "label"), 8)


def hot_region(spark, sf_dir):
    """Cells of a box that are in the part of the whole volume at over 15 % of the box's largest value, connected with it."""
    cells = volume(spark, sf_dir)
    box = cells.where(F.col("x").between(1, 6) & F.col("y").between(1, 6) & F.col("z").between(10, 40))
    top = box.agg(F.max_by(F.struct("x", "y", "z", "v"), F.struct("v", -index())).alias("t")).select("t.*").first()
    seed = (F.col("x") == top["x"]) & (F.col("y") == top["y"]) & (F.col("z") == top["z"])
    parts = C.components(cells.where(F.col("v") >= 0.15 * top["v"]), V.AXES, index(), 6)
    return C.touching(parts, parts.where(seed), V.AXES).join(box.select(*V.AXES), V.AXES, "left_semi").select(*V.AXES)


def planar_diameters(spark, sf_dir):
    """Longest distance between the points of a brand, and the extent perpendicular to it."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 7).alias("y"))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        longest, across = kernels.diameters(group[["x", "y"]].to_numpy())
        return pd.DataFrame([(group["p_brand"].iloc[0], longest, across)], columns=["p_brand", "longest", "across"])

    return rounded(p.groupBy("p_brand").applyInPandas(measure, "p_brand string, longest double, across double"), 6)


QUERIES = {
    "planar_diameters": planar_diameters, "contour_segments": contours, "contour_loops": loops, "polygon_areas": polygon_areas, "infill_lines": infill, "polygon_cells": polygon_cells, "vertex_normals": vertex_normals, "mesh_taubin": taubin, "voxel_boxes": boxed,
    "sweep_diameters": diameters, "hessian_eigenvalues": hessian, "two_stage": staged, "grown_statistics": grown, "share_histogram": binned, "hot_region": hot_region,
}

_POLY = """p AS (SELECT s_suppkey AS poly, i, c[1] * (1 + s_suppkey % 3) + s_suppkey * 0.13e0 AS x, c[2] * (1 + s_suppkey % 2) - s_suppkey * 0.07e0 AS y
        FROM supplier, (SELECT unnest(range(8)) AS i, unnest([[0.0e0, 0], [5, 2], [10, 0], [8, 5], [10, 10], [5, 8], [0, 10], [2, 5]]) AS c)),
    s AS (SELECT a.poly AS poly, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON a.poly = b.poly AND b.i = (a.i + 1) % 8)"""
_MESH = f"""v AS (SELECT range AS vertex, CAST(range % {W} AS DOUBLE) AS x, CAST(range // {W} AS DOUBLE) AS y, range * 7 % 11 / 2.0e0 AS z FROM range({W * D})),
    t AS (SELECT vertex AS a, vertex + 1 AS b, vertex + {W} AS c FROM v WHERE x < {W - 1} AND y < {D - 1} UNION ALL SELECT vertex + 1, vertex + {W + 1}, vertex + {W} FROM v WHERE x < {W - 1} AND y < {D - 1})"""
_LINK = "l AS (SELECT DISTINCT a AS p, b AS q FROM (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t UNION ALL SELECT b, a FROM t UNION ALL SELECT c, b FROM t UNION ALL SELECT a, c FROM t))"


def _smooth(source: str, to: str, share: float) -> str:
    moved = ", ".join(f"v.{a} + {share}e0 * (m.{a} - v.{a}) AS {a}" for a in "xyz")
    return f"{to} AS (SELECT v.vertex AS vertex, {moved} FROM {source} v JOIN (SELECT l.p AS p, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM l JOIN {source} ON vertex = q GROUP BY l.p) m ON m.p = v.vertex)"


_SPANS = """c AS (SELECT poly, unnest(range(CAST(ceil((least(y0, y1) - {o}) / {s}) AS BIGINT), CAST(ceil((greatest(y0, y1) - {o}) / {s}) AS BIGINT))) AS row, x0, y0, x1, y1 FROM s),
    h AS (SELECT poly, row, x0 + (row * {s} + {o} - y0) / (y1 - y0) * (x1 - x0) AS x FROM c), k AS (SELECT poly, row, x, row_number() OVER (PARTITION BY poly, row ORDER BY x) AS k FROM h), u AS (SELECT a.poly AS poly, a.row AS row, a.x AS x0, b.x AS x1 FROM k a JOIN k b ON a.poly = b.poly AND a.row = b.row AND a.k % 2 = 1 AND b.k = a.k + 1)"""
_D = lambda a: f"lead(v) OVER (PARTITION BY {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a}) + lag(v) OVER (PARTITION BY {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a}) - 2 * v"
_AT = lambda dx, dy, dz: f"(SELECT x - ({dx}) AS x, y - ({dy}) AS y, z - ({dz}) AS z, v FROM vol)"


def _mixed(a: str, b: str) -> str:
    one = {n: f"q{n}" for n in ("pp", "pm", "mp", "mm")}
    joins = " ".join(f"JOIN {_AT(*[(1 if s[0] == 'p' else -1) if c == a else (1 if s[1] == 'p' else -1) if c == b else 0 for c in 'xyz'])} {n} USING (x, y, z)" for s, n in one.items())
    return f"m{a}{b} AS (SELECT x, y, z, (qpp.v - qpm.v - qmp.v + qmm.v) / 4 AS d{a}{b} FROM vol {joins})"


def _segments(level: float) -> str:
    """Squares q, the middles of their sides, which sides each segment joins, and segments g (p to r)."""
    return f"""q AS (SELECT a.x AS x, a.y AS y, a.v >= {level} AS a, b.v >= {level} AS b, c.v >= {level} AS c, d.v >= {level} AS d FROM img a JOIN img b ON b.x = a.x + 1 AND b.y = a.y JOIN img c ON c.x = a.x + 1 AND c.y = a.y + 1 JOIN img d ON d.x = a.x AND d.y = a.y + 1),
        m AS (SELECT *, [[x + 0.5e0, y], [x + 1.0e0, y + 0.5e0], [x + 0.5e0, y + 1.0e0], [x + 0.0e0, y + 0.5e0]] AS e, list_filter([CASE WHEN a <> b THEN 1 END, CASE WHEN b <> c THEN 2 END, CASE WHEN c <> d THEN 3 END, CASE WHEN d <> a THEN 4 END], lambda k: k IS NOT NULL) AS k FROM q),
        n AS (SELECT e, unnest(CASE len(k) WHEN 2 THEN [k] WHEN 4 THEN CASE WHEN a THEN [[1, 4], [2, 3]] ELSE [[1, 2], [3, 4]] END ELSE [] END) AS s FROM m), g AS (SELECT e[s[1]] AS p, e[s[2]] AS r FROM n)"""


_EIGHT = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS o(dx, dy)"

ORACLE_SQL = {
    "contour_segments": f"""WITH {_IMG}, {_segments(0.1)}
        SELECT CAST(floor(least(p[2], r[2])) AS BIGINT) AS y, count(*) AS n, {_r('sum(sqrt(pow(p[1] - r[1], 2) + pow(p[2] - r[2], 2)))', 'length', 6)}, {_r('sum(p[1] + r[1])', 'places', 6)} FROM g GROUP BY 1""",
    "contour_loops": f"""WITH RECURSIVE {_IMG}, {_segments(0.25)}, e AS (SELECT CAST(p[1] * 2 AS BIGINT) * 2097152 + CAST(p[2] * 2 AS BIGINT) AS a, CAST(r[1] * 2 AS BIGINT) * 2097152 + CAST(r[2] * 2 AS BIGINT) AS b FROM g), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        c AS (SELECT a AS id, a AS root FROM w UNION SELECT w.b AS id, c.root AS root FROM c JOIN w ON w.a = c.id WHERE c.root < w.b), l AS (SELECT id, min(root) AS root FROM c GROUP BY id), d AS (SELECT a AS id, count(*) AS n FROM w GROUP BY a),
        o AS (SELECT root, count(*) FILTER (n = 1) = 0 AS closed FROM l JOIN d USING (id) GROUP BY root), s AS (SELECT l.root AS root, count(*) AS segments FROM e JOIN l ON l.id = e.a GROUP BY 1)
        SELECT segments, closed, count(*) AS loops FROM s JOIN o USING (root) GROUP BY 1, 2""",
    "planar_diameters": f"""WITH p AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice / 7 AS y FROM part), d AS (SELECT a.p_brand AS p_brand, b.x - a.x AS dx, b.y - a.y AS dy, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d FROM p a JOIN p b USING (p_brand) QUALIFY row_number() OVER (PARTITION BY a.p_brand ORDER BY d DESC, a.x, a.y) = 1)
        SELECT p_brand, {_r('any_value(d)', 'longest', 6)}, {_r('max((x * -dy + y * dx) / d) - min((x * -dy + y * dx) / d)', 'across', 6)} FROM p JOIN d USING (p_brand) GROUP BY p_brand""",
    "polygon_areas": f"WITH {_POLY} SELECT poly, {_r('sum((x1 - x0) * (y0 + y1)) / -2', 'area', 7)}, {_r('sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))', 'outline', 7)} FROM s GROUP BY poly",
    "infill_lines": f"WITH {_POLY}, {_SPANS.format(s='1.3e0', o='0.0e0')} SELECT poly, count(*) AS lines, {_r('sum(x1 - x0)', 'length', 6)} FROM u GROUP BY poly",
    "polygon_cells": f"""WITH {_POLY}, b AS (SELECT poly, floor(min(x)) AS lx, floor(max(x)) AS hx, floor(min(y)) AS ly, floor(max(y)) AS hy FROM p GROUP BY poly), r AS (SELECT poly, unnest(range(CAST(lx AS BIGINT), CAST(hx AS BIGINT) + 1)) AS x, ly, hy FROM b), g AS (SELECT poly, x, unnest(range(CAST(ly AS BIGINT), CAST(hy AS BIGINT) + 1)) AS y FROM r),
        n AS (SELECT g.poly AS poly, g.x AS x, g.y AS y, count(*) FILTER ((y0 <= g.y + 0.5e0) <> (y1 <= g.y + 0.5e0) AND x0 + (g.y + 0.5e0 - y0) / (y1 - y0) * (x1 - x0) <= g.x + 0.5e0) AS c FROM g JOIN s USING (poly) GROUP BY ALL)
        SELECT poly, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM n WHERE c % 2 = 1 GROUP BY poly""",
    "vertex_normals": f"""WITH {_MESH}, f AS (SELECT t.a AS a, t.b AS b, t.c AS c, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS wx, r.y - p.y AS wy, r.z - p.z AS wz FROM t JOIN v p ON p.vertex = t.a JOIN v q ON q.vertex = t.b JOIN v r ON r.vertex = t.c),
        n AS (SELECT unnest([a, b, c]) AS vertex, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM f), s AS (SELECT vertex, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM n GROUP BY vertex), z AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM s)
        SELECT vertex, {_r('nx / l', 'nx')}, {_r('ny / l', 'ny')}, {_r('nz / l', 'nz')} FROM z""",
    "mesh_taubin": f"WITH {_MESH}, {_LINK}, {_smooth('v', 'v1', 0.5)}, {_smooth('v1', 'v2', -0.53)} SELECT vertex, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')} FROM v2",
    "voxel_boxes": f"""WITH {_MESH}, b AS (SELECT least(p.x, q.x, r.x) AS x0, greatest(p.x, q.x, r.x) AS x1, least(p.y, q.y, r.y) AS y0, greatest(p.y, q.y, r.y) AS y1, least(p.z, q.z, r.z) AS z0, greatest(p.z, q.z, r.z) AS z1 FROM t JOIN v p ON p.vertex = t.a JOIN v q ON q.vertex = t.b JOIN v r ON r.vertex = t.c)
        SELECT DISTINCT i.range AS i, j.range AS j, k.range AS k FROM range({W}) i, range({D}) j, range(8) k WHERE EXISTS (SELECT 1 FROM b WHERE i.range BETWEEN floor(x0 / 1.5) AND floor(x1 / 1.5) AND j.range BETWEEN floor(y0 / 1.5) AND floor(y1 / 1.5) AND k.range BETWEEN floor(z0 / 1.5) AND floor(z1 / 1.5))""",
    "sweep_diameters": f"""WITH p AS (SELECT p_partkey AS id, p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y, CAST(p_partkey % 40 AS DOUBLE) AS z FROM part), s0 AS (SELECT p_brand, x, y, z FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY id) = 1),
        {', '.join(f"s{k + 1} AS (SELECT p.p_brand AS p_brand, p.x AS x, p.y AS y, p.z AS z, pow(p.x - s.x, 2) + pow(p.y - s.y, 2) + pow(p.z - s.z, 2) AS d{k + 1} FROM p JOIN s{k} s ON p.p_brand = s.p_brand QUALIFY row_number() OVER (PARTITION BY p.p_brand ORDER BY d{k + 1} DESC, id) = 1)" for k in range(3))}
        SELECT p_brand, {_r('sqrt(d3)', 'diameter', 7)} FROM s3""",
    "hessian_eigenvalues": f"""WITH {_VOL}, h AS (SELECT x, y, z, {_D('x')} AS a, {_D('y')} AS b, {_D('z')} AS c FROM vol), {_mixed('x', 'y')}, {_mixed('x', 'z')}, {_mixed('y', 'z')},
        j AS (SELECT z, a, b, c, dxy AS d, dxz AS e, dyz AS f FROM h JOIN mxy USING (x, y, z) JOIN mxz USING (x, y, z) JOIN myz USING (x, y, z) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
        SELECT z, {_r('sum(a + b + c)', 'trace', 6)}, {_r('sum(a * b * c + 2 * d * e * f - a * f * f - b * e * e - c * d * d)', 'det', 6)}, {_r('sum(a * a + b * b + c * c + 2 * (d * d + e * e + f * f))', 'squares', 6)}, count(*) AS rising FROM j GROUP BY z""",
    "two_stage": f"WITH {_IMG}, b AS (SELECT x // 8 AS bx, y // 8 AS row FROM img GROUP BY 1, 2 HAVING avg(v) > 0) SELECT CAST(x AS INTEGER) AS x, y, {_r('v', 'v')} FROM img JOIN b ON bx = x // 8 AND row = y // 8 WHERE v > 0.2",
    "grown_statistics": f"""WITH RECURSIVE {_IMG}, p AS (SELECT x, y, v FROM img WHERE v >= -0.12e0), f AS (SELECT x, y FROM p WHERE x = 12 AND y = 40 UNION SELECT p.x AS x, p.y AS y FROM f CROSS JOIN {_EIGHT} JOIN p ON p.x = f.x + dx AND p.y = f.y + dy)
        SELECT count(*) AS n, {_r('avg(v)', 'mean')}, {_r('min(v)', 'least')}, {_r('max(v)', 'largest')} FROM f JOIN p USING (x, y)""",
    "share_histogram": f"""WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), b AS (SELECT label, CAST(floor((least(greatest(v, -0.4e0), 0.4e0) - -0.4e0) / (0.4e0 - -0.4e0) * 32) AS INTEGER) AS bin, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT label, bin, {_r('n / sum(n) OVER (PARTITION BY label)', 'share')} FROM b""",
    "hot_region": f"""WITH RECURSIVE {_VOL}, box AS (SELECT * FROM vol WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND z BETWEEN 10 AND 40), top AS (SELECT x, y, z, v AS level FROM box ORDER BY v DESC, z, y, x LIMIT 1), m AS (SELECT vol.* FROM vol, top WHERE v >= 0.15e0 * level),
        f AS (SELECT x, y, z FROM top UNION SELECT m.x AS x, m.y AS y, m.z AS z FROM f JOIN m ON abs(m.x - f.x) + abs(m.y - f.y) + abs(m.z - f.z) = 1) SELECT x, y, z FROM f SEMI JOIN box USING (x, y, z)""",
}
