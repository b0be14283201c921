"""Queries of volumes, with their SQL. The volume is `embeddings`: slice vec_id, 8 x 8 cells a slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import voxels as V  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _r
from .tables import table

SIDE = 8
SPACING = {"x": 0.7, "y": 0.7, "z": 1.5}


def volume(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("z"), F.posexplode("embedding").alias("i", "v"))
    return cells.select((F.col("i") % SIDE).alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), "z", F.col("v").cast("double").alias("v"))


def depth(spark, sf_dir) -> dict[str, int]:
    return {"x": SIDE, "y": SIDE, "z": table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1}


def index():
    return (F.col("z").cast("long") * SIDE + F.col("y")) * SIDE + F.col("x")


def pairs(spark, sf_dir):
    return volume(spark, sf_dir).select("x", "y", "z", F.col("v").alias("a"), (F.col("v") * F.col("v") * 2).alias("b"))


def flow(spark, sf_dir):
    v = F.col("v")
    return volume(spark, sf_dir).select("x", "y", "z", (v * 3).alias("dx"), (v * v * 2).alias("dy"), (v * 2 + (F.col("z") % 7) * 0.1).alias("dz"))


def similarity(spark, sf_dir):
    return rounded(V.structural_similarity(pairs(spark, sf_dir)), 8)


def correlation(spark, sf_dir):
    return rounded(V.local_correlation(pairs(spark, sf_dir), 2), 6)


def noise_ratio(spark, sf_dir):
    return rounded(V.peak_ratio(pairs(spark, sf_dir)), 8)


def folding(spark, sf_dir):
    return rounded(V.jacobian_statistics(flow(spark, sf_dir)), 7)


def penalties(spark, sf_dir):
    f = flow(spark, sf_dir)
    return rounded(V.gradient_penalty(f).join(V.bending_energy(f)), 7)


def landmarks(spark, sf_dir):
    n = depth(spark, sf_dir)
    k = F.col("id")
    rows = spark.range(40).select("id", (k % 8).alias("x"), (k % 5 + 1).alias("y"), (k * 3 % (n["z"] - 2)).alias("z"))
    rows = rows.select("*", (F.col("x") + 0.25).alias("mx"), (F.col("y") * 0.9).alias("my"), (F.col("z") + k % 4 * 0.5 - 0.5).alias("mz"))
    e = V.landmark_errors(flow(spark, sf_dir), rows, n, SPACING)
    return rounded(e.agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("sd"), F.median("error").alias("median"), F.max("error").alias("largest"), F.min("error").alias("least")), 7)


def overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") + F.col("toxic")).alias("p"), (F.col("quality") * 2).alias("t"))
    return rounded(V.class_overlap(rows, "p", "t", 4), 8)


def resize(spark, sf_dir):
    n = depth(spark, sf_dir)
    return rounded(V.resampled_to(volume(spark, sf_dir), n, {"x": 5, "y": 12, "z": n["z"]}), 8)


def even_slices(spark, sf_dir):
    """All slices, which stand at uneven positions, at even steps."""
    n = depth(spark, sf_dir)["z"]
    places = V.even_places([k + k % 3 * 0.25 for k in range(n)], 0.75)
    return rounded(V.resampled(volume(spark, sf_dir), "z", places, n).select("x", "y", "z", "v"), 8)


def ball_dilation(spark, sf_dir):
    return V.dilated(volume(spark, sf_dir).where("v > 0.3"), 1, depth(spark, sf_dir)).groupBy("z").agg(F.count("*").alias("n"))


def ball_erosion(spark, sf_dir):
    return V.eroded(volume(spark, sf_dir).where("v > -0.15"), 1, depth(spark, sf_dir))


def table_removed(spark, sf_dir):
    blank = V.without_table(volume(spark, sf_dir), depth(spark, sf_dir), 0.0, (3.5, 3.5, 4.6), index(), -1.0)
    return rounded(blank.groupBy("z").agg(F.sum("v").alias("total"), F.count_if(F.col("v") == -1.0).alias("blank")), 8)


def air_spaces(spark, sf_dir):
    return V.lungs(volume(spark, sf_dir), depth(spark, sf_dir), -0.05, index())


def field_of_view(spark, sf_dir):
    return rounded(volume(spark, sf_dir).where(V.in_circle(3.5, 3.5, 3.2)).groupBy("z").agg(F.count("*").alias("n"), F.max("v").alias("top")), 8)


def used_slices(spark, sf_dir):
    return V.filled_slices(volume(spark, sf_dir), 0.25, 0.05).select("z").distinct()


def turned(spark, sf_dir):
    return rounded(V.transposed(volume(spark, sf_dir), "yxz").groupBy("x").agg(F.sum(F.col("v") * F.col("y")).alias("moment")), 6)


def padding(spark, sf_dir):
    n = depth(spark, sf_dir)
    p = V.padded(volume(spark, sf_dir), n, {"x": 10, "y": 9, "z": n["z"] + 1}, -2.0)
    return rounded(V.flattened(p, {"x": 10, "y": 9, "z": n["z"] + 1}).where("v < -0.3"), 8)


def point_statistics(spark, sf_dir):
    points = spark.range(200).select((F.col("id") % 11 - 1).cast("int").alias("x"), (F.col("id") % 7).cast("int").alias("y"), (F.col("id") % 13).cast("int").alias("z"))
    return rounded(V.bounded_statistics(points, volume(spark, sf_dir), 0.5), 8)


def stride(spark, sf_dir):
    return V.every_nth(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 400)


def local_peak(spark, sf_dir):
    """Largest mean of the ball round each cell over a level."""
    cells = volume(spark, sf_dir)
    offsets = spark.createDataFrame(V.ball(1), "dx int, dy int, dz int")
    centres = cells.where("v > 0.35").select(*[F.col(a).alias(f"c{a}") for a in V.AXES])
    near = centres.crossJoin(F.broadcast(offsets)).select("cx", "cy", "cz", *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(a) for a in V.AXES])
    means = near.join(cells, V.AXES).groupBy("cx", "cy", "cz").agg(F.avg("v").alias("m"))
    return rounded(means.agg(F.max("m").alias("peak"), F.count("*").alias("n")), 8)


def face_components(spark, sf_dir):
    """Components of face neighbours and of all neighbours, by size."""
    from ..operators.connected import components

    mask, parts = volume(spark, sf_dir).where("v > 0.16"), []
    for k in (6, 26):
        sizes = components(mask, V.AXES, index(), k).groupBy("label").agg(F.count("*").alias("size"))
        parts.append(sizes.groupBy("size").agg(F.count("*").alias("n")).withColumn("neighbours", F.lit(k)))
    return parts[0].unionByName(parts[1])


QUERIES = {
    "volume_similarity": similarity, "volume_local_correlation": correlation, "volume_noise_ratio": noise_ratio, "volume_folding": folding, "flow_penalties": penalties, "landmark_errors": landmarks,
    "class_overlap": overlap, "volume_resize": resize, "volume_even_slices": even_slices, "ball_dilation": ball_dilation, "ball_erosion": ball_erosion, "table_removal": table_removed, "air_spaces": air_spaces,
    "field_of_view": field_of_view, "used_slices": used_slices, "volume_transpose": turned, "volume_padding": padding, "bounded_statistics": point_statistics, "stride_sample": stride, "volume_ball_peak": local_peak,
    "volume_components": face_components,
}

_VOL = "vol AS (SELECT z, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT CAST(vec_id AS INTEGER) AS z, embedding, unnest(range(64)) AS i FROM embeddings))"
_FLOW = f"{_VOL}, flow AS (SELECT x, y, z, v * 3 AS dx, v * v * 2 AS dy, v * 2 + (z % 7) * 0.1e0 AS dz FROM vol)"
_OTHERS = {"x": "y, z", "y": "x, z", "z": "x, y"}


def _boxed(source: str, columns: list[str], radius: int, name: str) -> str:
    parts, last = [], source
    for k, axis in enumerate("xyz"):
        sums = ", ".join(f"sum({c}) OVER (PARTITION BY {_OTHERS[axis]} ORDER BY {axis} RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) / {2 * radius + 1} AS {c}" for c in columns)
        keep = ", a, b" if source == "p0" and name == "m" else ""
        parts.append(f"{name}{k} AS (SELECT x, y, z{keep}, {sums} FROM {last})")
        last = f"{name}{k}"
    return ", ".join(parts)


def _w(axis: str) -> str:
    return f"OVER (PARTITION BY {_OTHERS[axis]} ORDER BY {axis})"


_SLOPES = ", ".join(f"(lead({d}) {_w(a)} - lag({d}) {_w(a)}) / 2 AS {d}_{a}" for d in ("dx", "dy", "dz") for a in "xyz")
_DET = "(1 + dz_z) * ((1 + dy_y) * (1 + dx_x) - dy_x * dx_y) - dz_y * (dy_z * (1 + dx_x) - dy_x * dx_z) + dz_x * (dy_z * dx_y - (1 + dy_y) * dx_z)"
_FORWARD = ", ".join(f"pow(lead({d}) {_w(a)} - {d}, 2) AS {d}_{a}" for d in ("dx", "dy", "dz") for a in "xyz")
_SECOND = ", ".join(f"lead({d}) {_w(a)} + lag({d}) {_w(a)} - 2 * {d} AS {d}_{a}{a}" for d in ("dx", "dy", "dz") for a in "xyz")
_FIRST = ", ".join(f"lead({d}) {_w(a)} - {d} AS {d}_{a}" for d in ("dx", "dy", "dz") for a in "xy")
_CROSS = ", ".join(f"lead({d}_{a}) {_w(b)} - {d}_{a} AS {d}_{a}{b}" for d in ("dx", "dy", "dz") for a, b in ("xy", "xz", "yz"))


def _mean3(k: str, square: bool) -> str:
    return f"({' + '.join(f'sum({d}_{k} * {d}_{k})' if square else f'sum({d}_{k})' for d in ('dx', 'dy', 'dz'))}) / (3 * count(dx_{k}))"


_FACES = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS o(ox, oy, oz)"
_BALL = "(SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS o(ox, oy, oz))"
_IN = "x + ox BETWEEN 0 AND 7 AND y + oy BETWEEN 0 AND 7 AND z + oz BETWEEN 0 AND (SELECT max(z) FROM vol)"
_MOVED = f"SELECT CAST(x + ox AS INTEGER) AS x, CAST(y + oy AS INTEGER) AS y, CAST(z + oz AS INTEGER) AS z FROM {{0}} CROSS JOIN {_BALL} WHERE {_IN}"


def _axis_taps(name: str, size: int, target: int) -> str:
    at = f"((r.k + 0.5e0) * {size}.0e0 / {target} - 0.5e0)"
    return (f"{name} AS (SELECT out, cell, sum(w) AS w FROM (SELECT k AS out, greatest(0, least({size - 1}, CAST(floor(p) AS INTEGER))) AS cell, 1 - (p - floor(p)) AS w FROM (SELECT r.k AS k, {at} AS p FROM range({target}) r(k))"
            f" UNION ALL SELECT k, greatest(0, least({size - 1}, CAST(floor(p) AS INTEGER) + 1)), p - floor(p) FROM (SELECT r.k AS k, {at} AS p FROM range({target}) r(k))) GROUP BY 1, 2)")  # fmt: skip


_REACH = """r{n} AS (SELECT x, y, z, (CAST(z AS BIGINT) * 8 + y) * 8 + x AS root, (CAST(z AS BIGINT) * 8 + y) * 8 + x AS id FROM {source}
    UNION SELECT m.x AS x, m.y AS y, m.z AS z, r{n}.root AS root, (CAST(m.z AS BIGINT) * 8 + m.y) * 8 + m.x AS id FROM r{n} JOIN {source} m ON {near} WHERE r{n}.root < (CAST(m.z AS BIGINT) * 8 + m.y) * 8 + m.x)"""
_NEAR_SLICE = "m.z = r{n}.z AND abs(m.x - r{n}.x) + abs(m.y - r{n}.y) = 1"
_NEAR_6 = "m.z BETWEEN r{n}.z - 1 AND r{n}.z + 1 AND abs(m.x - r{n}.x) + abs(m.y - r{n}.y) + abs(m.z - r{n}.z) = 1"
_NEAR_26 = "m.z BETWEEN r{n}.z - 1 AND r{n}.z + 1 AND abs(m.x - r{n}.x) <= 1 AND abs(m.y - r{n}.y) <= 1"


def _reach(n: int, source: str, near: str) -> str:
    return _REACH.format(n=n, source=source, near=near.format(n=n))


ORACLE_SQL = {
    "volume_similarity": f"""WITH {_VOL}, p0 AS (SELECT x, y, z, v AS ma, v * v * 2 AS mb, v * v AS aa, pow(v * v * 2, 2) AS bb, v * (v * v * 2) AS ab FROM vol), {_boxed('p0', ['ma', 'mb', 'aa', 'bb', 'ab'], 3, 's')}
        SELECT {_r('avg((2 * ma * mb + 0.0001e0) * (2 * (ab - ma * mb) + 0.0009e0) / ((ma * ma + mb * mb + 0.0001e0) * (aa - ma * ma + bb - mb * mb + 0.0009e0)))', 'ssim', 8)} FROM s2""",
    "volume_local_correlation": f"""WITH {_VOL}, p0 AS (SELECT x, y, z, v AS a, v * v * 2 AS b, v AS ma, v * v * 2 AS mb FROM vol), {_boxed('p0', ['ma', 'mb'], 2, 'm')},
        q AS (SELECT x, y, z, (a - ma) * (b - mb) AS ab, pow(a - ma, 2) AS aa, pow(b - mb, 2) AS bb FROM m2), {_boxed('q', ['ab', 'aa', 'bb'], 2, 'n')} SELECT {_r('avg(ab / (sqrt(greatest(aa * bb, 0.0e0)) + 1e-5))', 'ncc', 6)} FROM n2""",
    "volume_noise_ratio": f"WITH {_VOL}, e AS (SELECT avg(pow(v - v * v * 2, 2)) AS mse FROM vol) SELECT {_r('mse', 'mse')}, {_r('10 * log10(1 / mse)', 'psnr')} FROM e",
    "volume_folding": f"WITH {_FLOW}, s AS (SELECT {_SLOPES} FROM flow), d AS (SELECT {_DET} AS det FROM s) SELECT {_r('avg(det)', 'mean', 7)}, {_r('stddev_samp(det)', 'sd', 7)}, {_r('min(det)', 'least', 7)}, {_r('max(det)', 'largest', 7)}, {_r('avg(CASE WHEN det <= 0 THEN 1.0e0 ELSE 0.0e0 END)', 'folded', 7)} FROM d WHERE det IS NOT NULL",
    "flow_penalties": f"""WITH {_FLOW}, g AS (SELECT {_FORWARD} FROM flow), s AS (SELECT {_SECOND} FROM flow), f AS (SELECT x, y, z, {_FIRST} FROM flow), c AS (SELECT {_CROSS} FROM f),
        a AS (SELECT {' + '.join(_mean3(k, False) for k in 'xyz')} AS penalty FROM g), b AS (SELECT {' + '.join(_mean3(k + k, True) for k in 'xyz')} AS e FROM s), d AS (SELECT 2 * ({' + '.join(_mean3(k, True) for k in ('xy', 'xz', 'yz'))}) AS e FROM c)
        SELECT {_r('penalty', 'penalty', 7)}, {_r('b.e + d.e', 'energy', 7)} FROM a, b, d""",
    "landmark_errors": f"""WITH {_FLOW}, n AS (SELECT max(z) + 1 AS n FROM vol), k AS (SELECT range AS id, range % 8 AS x, range % 5 + 1 AS y, range * 3 % (n - 2) AS z FROM range(40), n),
        l AS (SELECT *, x + 0.25e0 AS mx, y * 0.9e0 AS my, z + id % 4 * 0.5e0 - 0.5e0 AS mz FROM k),
        c AS (SELECT l.*, least(greatest(mx, 0), 7) AS px, least(greatest(my, 0), 7) AS py, least(greatest(mz, 0), n - 1) AS pz FROM l, n),
        t AS (SELECT c.id AS id, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dz) AS sz FROM (SELECT c.id AS id, f.dx, f.dy, f.dz, (1 - abs(px - f.x)) * (1 - abs(py - f.y)) * (1 - abs(pz - f.z)) AS w FROM c JOIN flow f ON abs(px - f.x) < 1 AND abs(py - f.y) < 1 AND abs(pz - f.z) < 1) c GROUP BY c.id),
        e AS (SELECT sqrt(pow((x - mx - sx) * 0.7e0, 2) + pow((y - my - sy) * 0.7e0, 2) + pow((z - mz - sz) * 1.5e0, 2)) AS error FROM l JOIN t USING (id))
        SELECT {_r('avg(error)', 'mean', 7)}, {_r('stddev_pop(error)', 'sd', 7)}, {_r('median(error)', 'median', 7)}, {_r('max(error)', 'largest', 7)}, {_r('min(error)', 'least', 7)} FROM e""",
    "class_overlap": f"""WITH r AS (SELECT quality + toxic AS p, quality * 2 AS t FROM labels), c AS (SELECT CAST(range AS INTEGER) AS class FROM range(1, 4)),
        d AS (SELECT class, (2.0e0 * (SELECT count(*) FROM r WHERE p = class AND t = class) + 1e-5) / ((SELECT count(*) FROM r WHERE p = class) + (SELECT count(*) FROM r WHERE t = class) + 1e-5) AS dice FROM c)
        SELECT class, {_r('dice', 'dice')} FROM d UNION ALL SELECT NULL, {_r('avg(dice)', 'dice')} FROM d""",
    "volume_resize": f"""WITH {_VOL}, {_axis_taps('tx', 8, 5)}, {_axis_taps('ty', 8, 12)}
        SELECT CAST(tx.out AS INTEGER) AS x, CAST(ty.out AS INTEGER) AS y, z, {_r('sum(tx.w * ty.w * v)', 'v')} FROM vol JOIN tx ON tx.cell = x JOIN ty ON ty.cell = y GROUP BY 1, 2, 3""",
    "volume_even_slices": f"""WITH {_VOL}, n AS (SELECT max(z) + 1 AS n FROM vol), p AS (SELECT i, i + i % 3 * 0.25e0 AS p FROM (SELECT unnest(range(n)) AS i FROM n)), o AS (SELECT k, k * 0.75e0 AS pos FROM (SELECT unnest(range(CAST(ceil((SELECT max(p) FROM p) / 0.75e0) AS BIGINT))) AS k)),
        l AS (SELECT k, pos, least(max(i), (SELECT n - 2 FROM n)) AS i FROM o JOIN p ON p <= pos GROUP BY k, pos), s AS (SELECT k, i, (pos - a.p) / (b.p - a.p) AS t FROM l JOIN p a USING (i) JOIN p b ON b.i = l.i + 1)
        SELECT u.x AS x, u.y AS y, CAST(k AS INTEGER) AS z, {_r('u.v * (1 - t) + w.v * t', 'v')} FROM s JOIN vol u ON u.z = i JOIN vol w ON w.z = i + 1 AND w.x = u.x AND w.y = u.y""",
    "ball_dilation": f"WITH {_VOL}, m AS (SELECT x, y, z FROM vol WHERE v > 0.3), d AS (SELECT DISTINCT * FROM ({_MOVED.format('m')})) SELECT z, count(*) AS n FROM d GROUP BY z",
    "ball_erosion": f"WITH {_VOL}, m AS (SELECT x, y, z FROM vol WHERE v > -0.15) SELECT x, y, z FROM ({_MOVED.format('m')}) GROUP BY x, y, z HAVING count(*) = 7",
    "table_removal": f"""WITH RECURSIVE {_VOL}, m AS (SELECT x, y, z FROM vol WHERE v > 0 AND pow(x - 3.5e0, 2) + pow(y - 3.5e0, 2) <= 4.6e0 * 4.6e0), {_reach(1, 'm', _NEAR_SLICE)},
        a AS (SELECT x, y, z, min(root) AS label FROM r1 GROUP BY x, y, z), s AS (SELECT z, label, row_number() OVER (PARTITION BY z ORDER BY count(*) DESC, label) AS k FROM a GROUP BY z, label),
        big AS (SELECT x, y, z FROM a JOIN s USING (z, label) WHERE k = 1), e AS (SELECT x, y, z FROM vol ANTI JOIN big USING (x, y, z)), {_reach(2, 'e', _NEAR_SLICE)},
        b AS (SELECT x, y, z, min(root) AS label FROM r2 GROUP BY x, y, z), o AS (SELECT DISTINCT label FROM b WHERE x IN (0, 7) OR y IN (0, 7)),
        body AS (SELECT x, y, z FROM big UNION ALL SELECT x, y, z FROM b WHERE label NOT IN (SELECT label FROM o)),
        q AS (SELECT vol.z AS z, CASE WHEN body.x IS NULL THEN -1.0e0 ELSE v END AS v FROM vol LEFT JOIN body ON vol.x = body.x AND vol.y = body.y AND vol.z = body.z)
        SELECT z, {_r('sum(v)', 'total')}, count(*) FILTER (v = -1.0) AS blank FROM q GROUP BY z""",
    "air_spaces": f"""WITH RECURSIVE {_VOL}, m AS (SELECT x, y, z FROM vol WHERE v < -0.05), n AS (SELECT max(z) AS n FROM vol),
        f AS (SELECT x, y, z FROM m, n WHERE z = 0 OR z = n OR y IN (0, 7) UNION SELECT m.x AS x, m.y AS y, m.z AS z FROM f CROSS JOIN {_FACES} JOIN m ON m.x = f.x + ox AND m.y = f.y + oy AND m.z = f.z + oz),
        i AS (SELECT x, y, z FROM m ANTI JOIN f USING (x, y, z)) SELECT DISTINCT x, y, z FROM ({_MOVED.format('i')})""",
    "field_of_view": f"WITH {_VOL} SELECT z, count(*) AS n, {_r('max(v)', 'top')} FROM vol WHERE pow(x - 3.5e0, 2) + pow(y - 3.5e0, 2) <= 3.2e0 * 3.2e0 GROUP BY z",
    "used_slices": f"WITH {_VOL} SELECT z FROM vol GROUP BY z HAVING avg(CASE WHEN v > 0.25 THEN 1.0e0 ELSE 0.0e0 END) >= 0.05",
    "volume_transpose": f"WITH {_VOL} SELECT y AS x, {_r('sum(v * x)', 'moment', 6)} FROM vol GROUP BY y",
    "volume_padding": f"""WITH {_VOL}, n AS (SELECT max(z) + 2 AS n FROM vol), f AS (SELECT range AS place, range % 10 AS x, range // 10 % 9 AS y, range // 90 AS z FROM (SELECT unnest(range(90 * n)) AS range FROM n))
        SELECT place, round(coalesce(v, -2.0e0), 8) + 0.0e0 AS v FROM f LEFT JOIN vol ON vol.x = f.x AND vol.y = f.y AND vol.z = f.z WHERE coalesce(v, -2.0e0) < -0.3""",
    "bounded_statistics": f"""WITH {_VOL}, p AS (SELECT range % 11 - 1 AS x, range % 7 AS y, range % 13 AS z FROM range(200)), i AS (SELECT v FROM p JOIN vol USING (x, y, z))
        SELECT {_r('avg(v)', 'mean')}, {_r('sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0e0))', 'sd')}, {_r('min(v)', 'least')}, {_r('max(v)', 'largest')}, 100.0e0 AS volume FROM i""",
    "stride_sample": "SELECT o_orderkey FROM orders WHERE o_orderkey % greatest(1, (SELECT count(*) FROM orders) // 400) = 0",
    "volume_ball_peak": f"""WITH {_VOL}, c AS (SELECT x, y, z FROM vol WHERE v > 0.35), m AS (SELECT c.x, c.y, c.z, avg(v.v) AS m FROM c CROSS JOIN {_BALL} JOIN vol v ON v.x = c.x + ox AND v.y = c.y + oy AND v.z = c.z + oz GROUP BY 1, 2, 3)
        SELECT {_r('max(m)', 'peak')}, count(*) AS n FROM m""",
    "volume_components": f"""WITH RECURSIVE {_VOL}, m AS (SELECT x, y, z FROM vol WHERE v > 0.16), {_reach(1, 'm', _NEAR_6)}, {_reach(2, 'm', _NEAR_26)},
        a AS (SELECT 6 AS neighbours, id, min(root) AS label FROM r1 GROUP BY id UNION ALL SELECT 26, id, min(root) FROM r2 GROUP BY id), s AS (SELECT neighbours, label, count(*) AS size FROM a GROUP BY 1, 2)
        SELECT CAST(neighbours AS INTEGER) AS neighbours, size, count(*) AS n FROM s GROUP BY 1, 2""",
}
