"""Queries of colours, meshes, tomography and tagged text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, extraction, lexicon
from ..operators import matching, meshes, tomography
from .evidence_queries import rounded
from .image_queries import _r
from .tables import table

SIZE, ANGLES, W, D = 12, 8, 40, 30


def _rgb(prefix: str = ""):
    k = F.col(f"{prefix}key")
    return [(k * m % 256) / 255.0 for m in (37, 91, 53)]


def colours(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return rounded(rows.select("key", *[c.alias(n) for c, n in zip(colour.lab(*_rgb()), ("l", "a", "b"), strict=True)]), 6)


def quantised(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    rows = rows.select("key", *[c.alias(n) for c, n in zip(colour.lab(*_rgb()), ("l", "a", "b"), strict=True)])
    palette = spark.range(16).select(F.col("id").alias("entry"), (F.col("id") * 17 + 3).alias("pkey"))
    palette = palette.select("entry", *[c.alias(n) for c, n in zip(colour.lab(*_rgb("p")), ("pl", "pa", "pb"), strict=True)])
    return matching.nearest(rows, palette, lambda e: F.round(colour.delta_e(tuple(map(F.col, "lab")), (e["pl"], e["pa"], e["pb"])), 9), "entry").select("key", "entry")


def mesh_edges(spark, sf_dir):
    return meshes.edge_report(meshes.height_field(spark, W, D)[1])


def mesh_weld(spark, sf_dir):
    v, t = meshes.weld(*meshes.height_field(spark, W, D), cell=2.0)
    return v.agg(F.count("*").alias("vertices")).join(t.agg(F.count("*").alias("triangles")))


def mesh_smooth(spark, sf_dir):
    v, t = meshes.height_field(spark, W, D)
    return rounded(meshes.smooth(v, t, 0.5), 8)


def mesh_measures(spark, sf_dir):
    return rounded(meshes.measures(*meshes.height_field(spark, W, D)), 6)


def mesh_slices(spark, sf_dir):
    heights = spark.range(10).select((F.col("id") * 0.5 + 0.3).alias("z"))
    return rounded(meshes.layer_lengths(meshes.slices(*meshes.height_field(spark, W, D), heights, 1.0)), 6)


def _phantom(spark):
    return tomography.ellipses(spark, SIZE, [(1.0, 0.0, 0.0, 0.8, 0.6, 0.0), (2.0, 0.2, 0.1, 0.3, 0.2, 30.0)])


def projection(spark, sf_dir):
    return rounded(tomography.project(tomography.system_matrix(spark, SIZE, ANGLES), _phantom(spark)), 6)


def mlem(spark, sf_dir):
    m = tomography.system_matrix(spark, SIZE, ANGLES)
    return rounded(tomography.mlem(m, tomography.project(m, _phantom(spark)), 2), 6)


def osem(spark, sf_dir):
    m = tomography.system_matrix(spark, SIZE, ANGLES)
    return rounded(tomography.mlem(m, tomography.project(m, _phantom(spark)), 1, subsets=2), 6)


def sirt(spark, sf_dir):
    m = tomography.system_matrix(spark, SIZE, ANGLES)
    return rounded(tomography.sirt(m, tomography.project(m, _phantom(spark)), 2), 6)


def tagged_text(spark, sf_dir):
    """The lexicon's adverse events over all documents and conversations."""
    both = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "conversations").select("text"))
    return both.groupBy(extraction.tags(F.lower("text"), lexicon.ADVERSE, "Not reported").alias("tags")).agg(F.count("*").alias("n"))


QUERIES = {
    "colour_lab": colours, "colour_quantise": quantised, "mesh_edges": mesh_edges, "mesh_weld": mesh_weld, "mesh_laplacian": mesh_smooth, "mesh_measures": mesh_measures, "mesh_slices": mesh_slices,
    "radon_projection": projection, "mlem": mlem, "osem": osem, "sirt": sirt, "keyword_tags": tagged_text,
}


def _lin(k: str, m: int) -> str:
    c = f"(({k} * {m} % 256) / 255.0e0)"
    return f"CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE pow(({c} + 0.055e0) / 1.055e0, 2.4e0) END"


def _lab_sql(k: str, source: str, keep: str) -> str:
    mix = [" + ".join(f"{a}e0 * {c}" for a, c in zip(row, ("lr", "lg", "lb"), strict=True)) for row in colour.TO_XYZ]
    f = [f"CASE WHEN {n} / {w}e0 > pow(6 / 29.0e0, 3) THEN pow({n} / {w}e0, 1 / 3.0e0) ELSE {n} / {w}e0 / (3 * pow(6 / 29.0e0, 2)) + 4 / 29.0e0 END" for n, w in zip("xyz", colour.WHITE, strict=True)]
    return f"""SELECT {keep}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM (SELECT {keep}, {f[0]} AS fx, {f[1]} AS fy, {f[2]} AS fz FROM (SELECT {keep}, {mix[0]} AS x, {mix[1]} AS y, {mix[2]} AS z
        FROM (SELECT {keep}, {_lin(k, 37)} AS lr, {_lin(k, 91)} AS lg, {_lin(k, 53)} AS lb FROM {source})))"""


_MESH = f"""v AS (SELECT range AS vertex, CAST(range % {W} AS DOUBLE) AS x, CAST(range // {W} AS DOUBLE) AS y, (range * 7 % 11) / 2.0e0 AS z FROM range({W * D})),
    q AS (SELECT vertex FROM v WHERE x < {W - 1} AND y < {D - 1}), t AS (SELECT vertex * 2 AS tri, vertex AS a, vertex + 1 AS b, vertex + {W} AS c FROM q UNION ALL SELECT vertex * 2 + 1, vertex + 1, vertex + {W + 1}, vertex + {W} FROM q),
    e AS (SELECT p, q, count(*) AS n FROM (SELECT least(a, b) AS p, greatest(a, b) AS q FROM t UNION ALL SELECT least(b, c), greatest(b, c) FROM t UNION ALL SELECT least(c, a), greatest(c, a) FROM t) GROUP BY p, q),
    k AS (SELECT t.tri AS tri, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM t JOIN v a ON t.a = a.vertex JOIN v b ON t.b = b.vertex JOIN v c ON t.c = c.vertex)"""
_C = (SIZE - 1) / 2
_TOMO = f"""g AS (SELECT a.range AS angle, d.range AS det, k.range AS k FROM range({ANGLES}) a, range({SIZE}) d, range({SIZE}) k),
    s AS (SELECT angle, det, (det - {_C}e0) * cos(angle * (pi() / {ANGLES})) - (k - {_C}e0) * sin(angle * (pi() / {ANGLES})) + {_C}e0 AS px, (det - {_C}e0) * sin(angle * (pi() / {ANGLES})) + (k - {_C}e0) * cos(angle * (pi() / {ANGLES})) + {_C}e0 AS py FROM g),
    o(dx, dy) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
    w4 AS (SELECT angle, det, CAST(floor(px) AS INTEGER) + dx AS x, CAST(floor(py) AS INTEGER) + dy AS y, (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM s, o),
    m AS (SELECT angle, det, x, y, sum(w) AS w FROM w4 WHERE x BETWEEN 0 AND {SIZE - 1} AND y BETWEEN 0 AND {SIZE - 1} AND w > 0 GROUP BY 1, 2, 3, 4),
    u AS (SELECT CAST(a.range AS INTEGER) AS x, CAST(b.range AS INTEGER) AS y, (2 * a.range - {SIZE - 1}) / {SIZE}.0e0 AS u, (2 * b.range - {SIZE - 1}) / {SIZE}.0e0 AS w FROM range({SIZE}) a, range({SIZE}) b),
    img AS (SELECT x, y, CASE WHEN u * u / 0.64e0 + w * w / 0.36e0 <= 1 THEN 1.0e0 ELSE 0.0e0 END + CASE WHEN pow((u - 0.2e0) * cos(radians(30)) + (w - 0.1e0) * sin(radians(30)), 2) / 0.09e0 + pow((w - 0.1e0) * cos(radians(30)) - (u - 0.2e0) * sin(radians(30)), 2) / 0.04e0 <= 1 THEN 2.0e0 ELSE 0.0e0 END AS v FROM u),
    sino AS (SELECT angle, det, sum(w * v) AS p FROM m JOIN img USING (x, y) GROUP BY 1, 2)"""


def _em(k: int, where: str = "") -> str:
    return f"""f{k} AS (SELECT angle, det, sum(w * v) AS f FROM m JOIN i{k} USING (x, y) {where} GROUP BY 1, 2), r{k} AS (SELECT angle, det, CASE WHEN f > 1e-10 THEN p / f ELSE 0.0e0 END AS r FROM f{k} JOIN sino USING (angle, det)),
    b{k} AS (SELECT x, y, sum(w * r) AS b, sum(w) AS s FROM m JOIN r{k} USING (angle, det) GROUP BY 1, 2), i{k + 1} AS (SELECT x, y, coalesce(v * b / greatest(s, 1e-10), v) AS v FROM i{k} LEFT JOIN b{k} USING (x, y))"""


_ONES = "i0 AS (SELECT DISTINCT x, y, 1.0e0 AS v FROM m)"
_SIRT = "rw AS (SELECT angle, det, sum(w) AS rw FROM m GROUP BY 1, 2), cw AS (SELECT x, y, sum(w) AS cw FROM m GROUP BY 1, 2), i0 AS (SELECT x, y, 0.0e0 AS v FROM cw)"
_SIRT_STEP = "f{0} AS (SELECT angle, det, sum(w * v) AS f FROM m JOIN i{0} USING (x, y) GROUP BY 1, 2), r{0} AS (SELECT angle, det, (p - f) / rw AS r FROM f{0} JOIN sino USING (angle, det) JOIN rw USING (angle, det)), b{0} AS (SELECT x, y, sum(w * r) AS b FROM m JOIN r{0} USING (angle, det) GROUP BY 1, 2), i{1} AS (SELECT x, y, greatest(0.0e0, v + b / cw) AS v FROM i{0} JOIN b{0} USING (x, y) JOIN cw USING (x, y))"

ORACLE_SQL = {
    "colour_lab": f"SELECT key, {_r('l', 'l', 6)}, {_r('a', 'a', 6)}, {_r('b', 'b', 6)} FROM ({_lab_sql('key', '(SELECT p_partkey AS key FROM part)', 'key')})",
    "colour_quantise": f"""WITH c AS ({_lab_sql('key', '(SELECT p_partkey AS key FROM part)', 'key')}), p AS ({_lab_sql('(entry * 17 + 3)', '(SELECT range AS entry FROM range(16))', 'entry')}),
        d AS (SELECT key, entry, row_number() OVER (PARTITION BY key ORDER BY round(sqrt(pow(c.l - p.l, 2) + pow(c.a - p.a, 2) + pow(c.b - p.b, 2)), 9), entry) AS r FROM c, p) SELECT key, entry FROM d WHERE r = 1""",
    "mesh_edges": f"WITH {_MESH} SELECT count(*) AS edges, count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n > 2) AS non_manifold FROM e",
    "mesh_weld": f"""WITH {_MESH}, g AS (SELECT vertex, min(vertex) OVER (PARTITION BY floor(x / 2), floor(y / 2), floor(z / 2)) AS n FROM v), w AS (SELECT a.n AS a, b.n AS b, c.n AS c FROM t JOIN g a ON t.a = a.vertex JOIN g b ON t.b = b.vertex JOIN g c ON t.c = c.vertex)
        SELECT (SELECT count(DISTINCT n) FROM g) AS vertices, (SELECT count(*) FROM w WHERE a <> b AND b <> c AND a <> c) AS triangles""",
    "mesh_laplacian": f"""WITH {_MESH}, n AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e), a AS (SELECT n.p AS vertex, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM n JOIN v ON n.q = v.vertex GROUP BY 1)
        SELECT vertex, {_r('x + 0.5e0 * (coalesce(mx, x) - x)', 'x')}, {_r('y + 0.5e0 * (coalesce(my, y) - y)', 'y')}, {_r('z + 0.5e0 * (coalesce(mz, z) - z)', 'z')} FROM v LEFT JOIN a USING (vertex)""",
    "mesh_measures": f"""WITH {_MESH}, n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM k)
        SELECT count(*) AS triangles, {_r('sum(sqrt(nx * nx + ny * ny + nz * nz) / 2)', 'area', 6)}, {_r('sum((ax * nx + ay * ny + az * nz) / 6)', 'volume', 6)}, min(least(ax, bx, cx)) AS x_min, max(greatest(ax, bx, cx)) AS x_max, min(least(ay, by_, cy)) AS y_min, max(greatest(ay, by_, cy)) AS y_max, min(least(az, bz, cz)) AS z_min, max(greatest(az, bz, cz)) AS z_max FROM n""",
    "mesh_slices": f"""WITH {_MESH}, h AS (SELECT range * 0.5e0 + 0.3e0 AS z FROM range(10)), s AS (SELECT tri, ax AS px, ay AS py, az AS pz, bx AS qx, by_ AS qy, bz AS qz FROM k UNION ALL SELECT tri, bx, by_, bz, cx, cy, cz FROM k UNION ALL SELECT tri, cx, cy, cz, ax, ay, az FROM k),
        c AS (SELECT h.z AS z, tri, px + (h.z - pz) / (qz - pz) * (qx - px) AS x, py + (h.z - pz) / (qz - pz) * (qy - py) AS y FROM s JOIN h ON (pz < h.z) <> (qz < h.z)),
        g AS (SELECT z, tri, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY z, tri HAVING count(*) = 2) SELECT round(z, 6) + 0.0e0 AS z, count(*) AS segments, {_r('sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))', 'length', 6)} FROM g GROUP BY z""",
    "radon_projection": f"WITH {_TOMO} SELECT CAST(angle AS INTEGER) AS angle, CAST(det AS INTEGER) AS det, {_r('p', 'p', 6)} FROM sino",
    "mlem": f"WITH {_TOMO}, {_ONES}, {_em(0)}, {_em(1)} SELECT x, y, {_r('v', 'v', 6)} FROM i2",
    "osem": f"WITH {_TOMO}, {_ONES}, {_em(0, 'WHERE angle % 2 = 0')}, {_em(1, 'WHERE angle % 2 = 1')} SELECT x, y, {_r('v', 'v', 6)} FROM i2",
    "sirt": f"WITH {_TOMO}, {_SIRT}, {_SIRT_STEP.format(0, 1)}, {_SIRT_STEP.format(1, 2)} SELECT x, y, {_r('v', 'v', 6)} FROM i2",
    "keyword_tags": "WITH t AS (SELECT lower(text) AS t FROM documents UNION ALL SELECT lower(text) FROM conversations), c AS (SELECT concat_ws('; ', {}) AS tags FROM t) SELECT CASE WHEN tags = '' THEN 'Not reported' ELSE tags END AS tags, count(*) AS n FROM c GROUP BY 1".format(
        ", ".join(f"CASE WHEN regexp_matches(t, '(?i){'|'.join(f'(?:{x})' for x in p)}') THEN '{k}' END" for k, p in lexicon.ADVERSE.items())
    ),
}
