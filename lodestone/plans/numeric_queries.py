"""Queries of scalar functions and ordered paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N  # noqa: N812
from ..operators import paths as P  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _IMG, _r, image
from .tables import table

KINDS = ["ramp", "shepp-logan", "cosine", "hamming", "hann"]
TURN = (0.9, 0.2, -0.3, 0.1)
STEP = 25.0


def curves(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("t"), *[(F.col("p_retailprice") * k % 256).alias(f"v{i}") for i, k in enumerate((1, 3, 5, 7))])
    values = [F.col(f"v{i}") for i in range(4)]
    c, b = N.catmull_rom(F.col("t"), values), N.b_spline(F.col("t"), values)
    return rounded(p.select("p_partkey", c.alias("through"), b.alias("near"), N.clamped_byte(F.round(c, 6)).alias("byte")), 6)


def rotations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y, z = N.rotated(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 17).cast("double"), TURN)
    return rounded(p.select("p_partkey", x.alias("x"), y.alias("y"), z.alias("z")), 8)


def responses(spark, sf_dir):
    f = spark.range(129).select((F.col("id") / 128.0).alias("f"))
    return rounded(f.select("f", *[N.filter_response(k, F.col("f")).alias(k.replace("-", "_")) for k in KINDS]), 9)


def energies(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v, other = F.col("c_acctbal"), F.col("c_custkey") % 1000 * 10.0
    return rounded(c.select("c_custkey", N.gaussian(v, F.lit(4500.0), F.lit(1500.0)).alias("density"), N.edge_weight(v, other, 90.0).alias("passage"), N.unary_energy(F.abs(v) / 10000).alias("alone"), N.pairwise_energy(v, other, 800.0).alias("together")), 10)


def probabilities(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("s"))
    return rounded(e.select("vec_id", N.argmax(F.col("s")).alias("best"), F.array_max(N.softmax(F.col("s"))).alias("p")), 8)


def inks(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", *[((k * m % 256) / 255.0).alias(n) for n, m in (("r", 37), ("g", 91), ("b", 151))])
    c, m, y, black = N.to_cmyk(F.col("r"), F.col("g"), F.col("b"))
    p = p.select("*", c.alias("c"), m.alias("m"), y.alias("y"), black.alias("k"), N.gamma(F.col("r"), 2.2).alias("dark"))
    back = N.from_cmyk(*[F.col(n) for n in "cmyk"])
    return rounded(p.select("p_partkey", "c", "m", "y", "k", "dark", sum(back[1:], back[0]).alias("light")), 8)


def scaled(spark, sf_dir):
    cells = image(spark, sf_dir)
    ends = cells.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(cells.join(F.broadcast(ends), "x").select("x", "y", N.minmax(F.col("v"), F.col("low"), F.col("high")).alias("v")), 8)


def _moves(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_id") % 97).cast("double").alias("x"), (F.col("event_id") * 7 % 89).cast("double").alias("y"))


def colour_changes(spark, sf_dir):
    return P.colour_changes(_moves(spark, sf_dir), ["user_id"], ["event_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("changes"))


def extrusion(spark, sf_dir):
    total = P.running_total(_moves(spark, sf_dir), ["user_id"], ["event_id"], P.filament(F.col("value"), 0.4, 0.2, 1.75))
    return rounded(total.select("user_id", "event_id", "total"), 6)


def overhangs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("layer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    layers = o.groupBy("o_orderstatus", "layer").agg(F.sum("cents").alias("area"))
    return P.overhangs(layers, ["o_orderstatus"], ["layer"], "area").select("o_orderstatus", "layer", "area", "below")


def memory(spark, sf_dir):
    rows = P.last_frames(_moves(spark, sf_dir), ["user_id"], ["event_id"], "event_type", 4)
    return rows.select("event_id", F.concat_ws(",", "memory").alias("memory"))


def even_points(spark, sf_dir):
    return rounded(P.even_points(_moves(spark, sf_dir), ["user_id"], ["event_id"], ["x", "y"], STEP).withColumn("place", F.col("place")), 5)


def contour_points(spark, sf_dir):
    dense = P.densified(_moves(spark, sf_dir), ["user_id"], ["event_id"], ["x", "y"])
    return rounded(dense.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")), 4)


def commands(spark, sf_dir):
    line = F.when(F.col("event_type") == "click", F.format_string("G1 X%.3f Y%.3f", "x", "y")).when(F.col("event_type") == "view", F.format_string("G0 X%.3f", "x")).when(F.col("event_type") == "purchase", F.lit("  ; part")).otherwise(F.concat(F.lit("M"), F.col("event_id") % 3))
    return P.command_counts(_moves(spark, sf_dir).select(line.alias("line")), "line")


QUERIES = {
    "cubic_curves": curves, "quaternion_rotation": rotations, "filter_responses": responses, "pixel_energies": energies, "softmax_argmax": probabilities, "ink_separation": inks, "column_minmax": scaled,
    "colour_changes": colour_changes, "extrusion_totals": extrusion, "layer_overhangs": overhangs, "frame_memory": memory, "even_path_points": even_points, "contour_densify": contour_points, "print_commands": commands,
}

_MOVES = "m AS (SELECT user_id, event_id, event_type, value, CAST(event_id % 97 AS DOUBLE) AS x, CAST(event_id * 7 % 89 AS DOUBLE) AS y FROM events)"
_O = "OVER (PARTITION BY user_id ORDER BY event_id)"
_T = "p_size / 50.0e0"


def _rotation() -> str:
    n = sum(q * q for q in TURN) ** 0.5
    w, a, b, c = (q / n for q in TURN)
    rows = [(w * w + a * a - b * b - c * c, 2 * a * b - 2 * w * c, 2 * a * c + 2 * w * b), (2 * a * b + 2 * w * c, w * w - a * a + b * b - c * c, 2 * b * c - 2 * w * a), (2 * a * c - 2 * w * b, 2 * b * c + 2 * w * a, w * w - a * a - b * b + c * c)]
    return ", ".join(_r(f"p_size * ({r[0]!r}e0) + p_retailprice / 100 * ({r[1]!r}e0) + (p_partkey % 17) * ({r[2]!r}e0)", name) for r, name in zip(rows, "xyz", strict=True))


ORACLE_SQL = {
    "cubic_curves": f"""WITH p AS (SELECT p_partkey, {_T} AS t, p_retailprice % 256 AS a, p_retailprice * 3 % 256 AS b, p_retailprice * 5 % 256 AS c, p_retailprice * 7 % 256 AS d FROM part),
        q AS (SELECT p_partkey, b + t * ((c - a) / 2 + t * ((a - 2.5e0 * b + 2 * c - d / 2) + t * (1.5e0 * b - a / 2 - 1.5e0 * c + d / 2))) AS u,
            (pow(1 - t, 3) * a + (4 - 6 * t * t + 3 * t * t * t) * b + (1 + 3 * t + 3 * t * t - 3 * t * t * t) * c + t * t * t * d) / 6 AS w FROM p)
        SELECT p_partkey, {_r('u', 'through', 6)}, {_r('w', 'near', 6)}, CAST(floor(greatest(0, least(255, round(u, 6)))) AS INTEGER) AS byte FROM q""",
    "quaternion_rotation": f"SELECT p_partkey, {_rotation()} FROM part",
    "filter_responses": f"""WITH f AS (SELECT range / 128.0e0 AS f FROM range(129)) SELECT round(f, 9) AS f, {_r('f', 'ramp', 9)}, {_r('CASE WHEN f = 0 THEN 0.0e0 ELSE 2 / pi() * sin(pi() * f / 2) END', 'shepp_logan', 9)},
        {_r('f * cos(pi() * f / 2)', 'cosine', 9)}, {_r('f * (0.54e0 + 0.46e0 * cos(pi() * f))', 'hamming', 9)}, {_r('f * pow(cos(pi() * f / 2), 2)', 'hann', 9)} FROM f""",
    "pixel_energies": f"""WITH c AS (SELECT c_custkey, c_acctbal AS v, c_custkey % 1000 * 10.0e0 AS o FROM customer) SELECT c_custkey, {_r('exp(-pow((v - 4500) / 1500, 2) / 2) / (1500 * sqrt(2 * pi()))', 'density', 10)},
        {_r('exp(-90 * pow((v - o) / 65536, 2))', 'passage', 10)}, {_r('-ln(abs(v) / 10000 + 0.01e0)', 'alone', 10)}, {_r('exp(-pow((v - o) / 800, 2) / 2)', 'together', 10)} FROM c""",
    "softmax_argmax": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10) AS s FROM embeddings), m AS (SELECT vec_id, s, list_max(s) AS top FROM e)
        SELECT vec_id, CAST(list_position(s, top) - 1 AS INTEGER) AS best, {_r('1 / list_sum(list_transform(s, lambda v: exp(v - top)))', 'p')} FROM m""",
    "ink_separation": f"""WITH p AS (SELECT p_partkey, p_partkey * 37 % 256 / 255.0e0 AS r, p_partkey * 91 % 256 / 255.0e0 AS g, p_partkey * 151 % 256 / 255.0e0 AS b FROM part), w AS (SELECT *, greatest(r, g, b) AS w FROM p)
        SELECT p_partkey, {_r('CASE WHEN w <= 1e-10 THEN 0 ELSE 1 - r / w END', 'c')}, {_r('CASE WHEN w <= 1e-10 THEN 0 ELSE 1 - g / w END', 'm')}, {_r('CASE WHEN w <= 1e-10 THEN 0 ELSE 1 - b / w END', 'y')}, {_r('1 - w', 'k')}, {_r('pow(r, 2.2e0)', 'dark')}, {_r('r + g + b', 'light')} FROM w""",
    "column_minmax": f"WITH {_IMG} SELECT CAST(x AS INTEGER) AS x, y, {_r('(v - min(v) OVER (PARTITION BY x)) / (max(v) OVER (PARTITION BY x) - min(v) OVER (PARTITION BY x) + 1e-8)', 'v')} FROM img",
    "colour_changes": f"WITH {_MOVES}, c AS (SELECT user_id, event_type IS DISTINCT FROM lag(event_type) {_O} AS c FROM m) SELECT user_id, count(*) FILTER (c) AS changes FROM c GROUP BY user_id",
    "extrusion_totals": f"WITH {_MOVES} SELECT user_id, event_id, {_r(f'sum(value * (0.08e0 / (pi() * 0.765625e0))) {_O}', 'total', 6)} FROM m",
    "layer_overhangs": """WITH l AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS layer, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS area FROM orders GROUP BY 1, 2),
        b AS (SELECT *, lag(area) OVER (PARTITION BY o_orderstatus ORDER BY layer) AS below FROM l) SELECT o_orderstatus, layer, area, below FROM b WHERE area > 1.1e0 * below""",
    "frame_memory": f"WITH {_MOVES} SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS memory FROM m",
    "even_path_points": f"""WITH {_MOVES}, p AS (SELECT user_id, event_id, x, y, lag(x) {_O} AS x0, lag(y) {_O} AS y0 FROM m), l AS (SELECT *, coalesce(sqrt(pow(x - x0, 2) + pow(y - y0, 2)), 0) AS len FROM p), u AS (SELECT *, sum(len) {_O} AS until FROM l),
        s AS (SELECT *, unnest(range(CAST(floor((until - len) / {STEP}e0) AS BIGINT) + 1, CAST(floor(until / {STEP}e0) AS BIGINT) + 1)) AS place FROM u WHERE len > 0)
        SELECT user_id, CAST(0 AS BIGINT) AS place, x, y FROM p WHERE x0 IS NULL
        UNION ALL SELECT user_id, place, {_r(f'x0 + (place * {STEP}e0 - until + len) / len * (x - x0)', 'x', 5)}, {_r(f'y0 + (place * {STEP}e0 - until + len) / len * (y - y0)', 'y', 5)} FROM s""",
    "contour_densify": f"""WITH {_MOVES}, p AS (SELECT user_id, x, y, coalesce(lead(x) {_O}, first_value(x) {_O}) AS x1, coalesce(lead(y) {_O}, first_value(y) {_O}) AS y1 FROM m),
        s AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow(x1 - x, 2) + pow(y1 - y, 2))) AS INTEGER)) AS n FROM p), q AS (SELECT *, unnest(range(n)) AS k FROM s)
        SELECT user_id, count(*) AS n, {_r('sum(x + (x1 - x) * k / n)', 'x', 4)}, {_r('sum(y + (y1 - y) * k / n)', 'y', 4)} FROM q GROUP BY user_id""",
    "print_commands": "SELECT CASE event_type WHEN 'click' THEN 'G1' WHEN 'view' THEN 'G0' WHEN 'purchase' THEN 'comment' ELSE 'M' || (event_id % 3) END AS command, count(*) AS n FROM events GROUP BY 1",
}
