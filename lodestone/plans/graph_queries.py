"""Queries of components, matching and clustering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as K  # noqa: N812
from ..operators import connected as C  # noqa: N812
from ..operators import matching as M  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _IMG, WIDTH, _r, image
from .tables import table

AXES = ["x", "y"]


def index():
    """Place in scan order."""
    return F.col("y") * WIDTH + F.col("x")


def _mask(spark, sf_dir, level=0.2):
    return image(spark, sf_dir).where(F.col("v") > level)


def components_4(spark, sf_dir):
    return C.numbered(C.components(_mask(spark, sf_dir), AXES, index(), 4)).select("x", "y", "label")


def components_8(spark, sf_dir):
    labelled = C.components(_mask(spark, sf_dir), AXES, index(), 8)
    return labelled.groupBy("label").agg(F.count("*").alias("area"))


def largest_component(spark, sf_dir):
    return C.largest(C.components(_mask(spark, sf_dir), AXES, index(), 8)).select("x", "y")


def region_growing(spark, sf_dir):
    cells = image(spark, sf_dir)
    seeds = cells.where((F.col("y") % 50 == 0) & (F.col("x") == 10)).select("x", "y")
    return C.grow(cells, seeds, lambda v, mean: C.within(v, mean, "difference", 0.06), AXES, index(), 4).select("x", "y")


def fill_holes(spark, sf_dir):
    cells = image(spark, sf_dir)
    height = cells.agg(F.max("y")).first()[0] + 1
    border = (F.col("x") == 0) | (F.col("x") == WIDTH - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)
    return C.fill_holes(cells.where("v > -0.05").select("x", "y"), cells.select("x", "y"), AXES, index(), border)


def threshold_region(spark, sf_dir):
    return C.threshold_region(image(spark, sf_dir), {"x": 12, "y": 40}, None, -0.12, AXES, index(), 8).select("x", "y")


def nearest_palette(spark, sf_dir):
    """Customers with the nearest of all suppliers by balance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("at"))
    palette = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry"), F.col("s_acctbal").alias("at"))
    return rounded(M.nearest_on_line(rows, palette, "c_custkey", "at", "entry"), 6)


def range_join(spark, sf_dir):
    planes = spark.range(0, 600_000, 2500).select((F.col("id") + 0.5).alias("z"))
    ranges = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") * 1.02).alias("hi"))
    return M.range_join(planes, ranges, "z", "lo", "hi", 5000.0).groupBy("z").agg(F.count("*").alias("n"))


def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return rounded(M.as_of(left, right, ["user_id"], "ts", ["value"]).select("event_id", "user_id", F.col("r_value").alias("value")), 6)


def bracketing(spark, sf_dir):
    """The mean price at every quantity for every supplier, from all of the supplier's quantities."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"), "l_extendedprice")
    knots = li.groupBy("l_suppkey", "q").agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 100).alias("price"))
    left = knots.select("l_suppkey").distinct().crossJoin(F.broadcast(knots.select("q").distinct()))
    return rounded(M.bracket(left, knots, ["l_suppkey"], "q", "price"), 6)


def _points(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), (F.col("p_partkey") % 40).cast("double").alias("z"))


def within_distance(spark, sf_dir):
    return rounded(M.within_distance(_points(spark, sf_dir), 2.0), 6)


def nearest_three(spark, sf_dir):
    return rounded(M.nearest_within(_points(spark, sf_dir), 4.0, 3, 9), 6)


def gap_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return M.grouped_by_gap(rows, ["user_id"], "value", 3.0).groupBy("user_id").agg((F.max("grp") + 1).alias("groups"))


def semi_anti(spark, sf_dir):
    """Cells of a lower threshold that aren't cells of a higher one, and those of one of two masks only."""
    low, high = _mask(spark, sf_dir, 0.1).select("x", "y"), _mask(spark, sf_dir, 0.2).select("x", "y")
    return low.join(high, AXES, "left_anti").groupBy("y").agg(F.count("*").alias("n"))


def symmetric_difference(spark, sf_dir):
    cells = image(spark, sf_dir)
    a, b = cells.where("v > 0.1").select("x", "y"), cells.where("v < 0.2").select("x", "y")
    return a.union(b).groupBy("x", "y").agg(F.count("*").alias("c")).where("c % 2 = 1").groupBy("y").agg(F.count("*").alias("n"))


def kmeans_1d(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    centres = K.kmeans(rows, "c_acctbal", K.evenly_picked(rows, "c_acctbal", "c_custkey", 3), 4)
    return rounded(rows.select(K.closest(F.col("c_acctbal"), centres).alias("cluster"), "c_acctbal").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")), 6)


def mixture_1d(spark, sf_dir):
    parts = K.mixture(table(spark, sf_dir, "customer"), "c_acctbal", 3, 5)
    return rounded(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(parts)], "part int, weight double, mean double, sd double"), 6)


QUERIES = {
    "components_4": components_4, "components_8": components_8, "largest_component": largest_component, "region_growing": region_growing, "fill_holes": fill_holes, "threshold_region": threshold_region,
    "nearest_palette": nearest_palette, "range_join": range_join, "as_of_join": as_of_join, "bracketing_join": bracketing, "distance_join": within_distance, "nearest_three": nearest_three,
    "anchor_groups": gap_groups, "mask_difference": semi_anti, "mask_symmetric_difference": symmetric_difference, "kmeans_1d": kmeans_1d, "gaussian_mixture_1d": mixture_1d,
}

_REACH = """m AS (SELECT x, y, y * 64 + x AS id FROM img WHERE v > 0.2), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id AND a.y BETWEEN b.y - 1 AND b.y + 1{four}),
    r AS (SELECT id, id AS root FROM m UNION SELECT e.b AS id, r.root AS root FROM r JOIN e ON r.id = e.a), l AS (SELECT id, min(root) AS label FROM r GROUP BY id)"""
_SHIFT = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)"


def _flood(start: str, passed: str, shift: str = _SHIFT) -> str:
    """Cells of `passed` reached from `start` over the neighbours of `shift`."""
    return f"p AS ({passed}), f AS ({start} UNION SELECT p.x AS x, p.y AS y FROM f CROSS JOIN {shift} JOIN p ON p.x = f.x + dx AND p.y = f.y + dy)"


def _kmeans_sql(rounds: int) -> str:
    parts = ["c AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)", "k0 AS (SELECT max(v) FILTER (r = 0) AS a, max(v) FILTER (r = n // 3) AS b, max(v) FILTER (r = 2 * (n // 3)) AS d FROM c)"]
    near = "CASE WHEN abs(v - a) <= abs(v - b) AND abs(v - a) <= abs(v - d) THEN 0 WHEN abs(v - b) <= abs(v - d) THEN 1 ELSE 2 END"
    for i in range(rounds):
        parts.append(f"g{i} AS (SELECT {near} AS g, v FROM c, k{i}), k{i + 1} AS (SELECT avg(v) FILTER (g = 0) AS a, avg(v) FILTER (g = 1) AS b, avg(v) FILTER (g = 2) AS d FROM g{i})")
    return f"WITH {', '.join(parts)} SELECT {near} AS cluster, count(*) AS n, {_r('avg(v)', 'mean', 6)} FROM c, k{rounds} GROUP BY 1"


def _mixture_sql(k: int, rounds: int) -> str:
    """EM written out round by round, one row of weights, means and deviations after each."""
    part = range(k)
    start = ", ".join(f"1 / {k}.0e0 AS w{i}, low + (high - low) * {i + 0.5}e0 / {k} AS m{i}, greatest(sd / {k}, 1e-3) AS s{i}" for i in part)
    steps = ["c AS (SELECT c_acctbal AS v FROM customer)", f"p0 AS (SELECT {start} FROM (SELECT min(v) AS low, max(v) AS high, stddev_pop(v) AS sd FROM c))"]
    for r in range(rounds):
        density = ", ".join(f"w{i} * exp(-pow((v - m{i}) / s{i}, 2) / 2) / (s{i} * sqrt(2 * pi())) AS g{i}" for i in part)
        total = " + ".join(f"g{i}" for i in part)
        steps.append(f"d{r} AS (SELECT v, {density} FROM c, p{r}), q{r} AS (SELECT v, {', '.join(f'g{i} / greatest({total}, 1e-300) AS r{i}' for i in part)} FROM d{r})")
        sums = ", ".join(f"sum(r{i}) AS a{i}, sum(r{i} * v) AS b{i}, sum(r{i} * v * v) AS e{i}" for i in part)
        steps.append(f"u{r} AS (SELECT count(*) AS n, {sums} FROM q{r}), p{r + 1} AS (SELECT {', '.join(f'a{i} / n AS w{i}, b{i} / a{i} AS m{i}, greatest(sqrt(greatest(e{i} / a{i} - pow(b{i} / a{i}, 2), 0)), 1e-3) AS s{i}' for i in part)} FROM u{r})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS part, {_r(f'w{i}', 'weight', 6)}, {_r(f'm{i}', 'mean', 6)}, {_r(f's{i}', 'sd', 6)} FROM p{rounds}" for i in part)


_PTS = "p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y, CAST(p_partkey % 40 AS DOUBLE) AS z FROM part), d AS (SELECT a.id AS id, b.id AS id2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM p a JOIN p b ON a.id <> b.id AND a.x BETWEEN b.x - 4 AND b.x + 4)"
_EIGHT = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS o(dx, dy)"

ORACLE_SQL = {
    "components_4": f"WITH RECURSIVE {_IMG}, {_REACH.format(four=' AND abs(a.x - b.x) + abs(a.y - b.y) = 1')} SELECT CAST(x AS INTEGER) AS x, y, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS label FROM l JOIN m USING (id)",
    "components_8": f"WITH RECURSIVE {_IMG}, {_REACH.format(four='')} SELECT label, count(*) AS area FROM l GROUP BY label",
    "largest_component": f"WITH RECURSIVE {_IMG}, {_REACH.format(four='')}, b AS (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT CAST(x AS INTEGER) AS x, y FROM l JOIN m USING (id) WHERE label IN (SELECT label FROM b)",
    "region_growing": f"""WITH RECURSIVE {_IMG}, s AS (SELECT x, y, v FROM img WHERE y % 50 = 0 AND x = 10), a AS (SELECT avg(v) AS m FROM s),
        {_flood('SELECT x, y FROM s', 'SELECT x, y FROM img, a WHERE abs(v - m) <= 0.06e0 OR (y % 50 = 0 AND x = 10)')} SELECT CAST(x AS INTEGER) AS x, y FROM f""",
    "fill_holes": f"""WITH RECURSIVE {_IMG}, h AS (SELECT max(y) AS h FROM img), {_flood('SELECT x, y FROM p, h WHERE x = 0 OR x = 63 OR y = 0 OR y = h', 'SELECT x, y FROM img WHERE NOT v > -0.05')}
        SELECT CAST(x AS INTEGER) AS x, y FROM img WHERE (x, y) NOT IN (SELECT (x, y) FROM f)""",
    "threshold_region": f"WITH RECURSIVE {_IMG}, {_flood('SELECT x, y FROM p WHERE x = 12 AND y = 40', 'SELECT x, y FROM img WHERE v >= -0.12e0', _EIGHT)} SELECT CAST(x AS INTEGER) AS x, y FROM f",
    "nearest_palette": f"WITH d AS (SELECT c_custkey, s_suppkey AS entry, abs(c_acctbal - s_acctbal) AS d FROM customer, supplier), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, entry) AS r FROM d) SELECT c_custkey, entry, {_r('d', 'distance', 6)} FROM r WHERE r = 1",
    "range_join": "WITH z AS (SELECT range + 0.5e0 AS z FROM range(0, 600000, 2500)) SELECT z, count(*) AS n FROM z JOIN orders ON z >= o_totalprice AND z <= o_totalprice * 1.02e0 GROUP BY z",
    "as_of_join": f"""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT event_id, l.user_id AS user_id, {_r('value', 'value', 6)} FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "bracketing_join": f"""WITH k AS (SELECT l_suppkey, l_quantity AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS price FROM lineitem GROUP BY 1, 2),
        l AS (SELECT l_suppkey, q FROM (SELECT DISTINCT l_suppkey FROM k), (SELECT DISTINCT q FROM k)),
        x AS (SELECT l.l_suppkey AS l_suppkey, l.q AS q, k.q AS lo, k.price AS plo FROM l ASOF LEFT JOIN k ON l.l_suppkey = k.l_suppkey AND l.q >= k.q),
        b AS (SELECT x.l_suppkey AS l_suppkey, x.q AS q, lo, plo, k.q AS hi, k.price AS phi FROM x ASOF LEFT JOIN k ON x.l_suppkey = k.l_suppkey AND x.q <= k.q)
        SELECT l_suppkey, q, {_r('coalesce(plo + CASE WHEN hi > lo THEN (q - lo) / (hi - lo) ELSE 0.0e0 END * (phi - plo), plo, phi)', 'price', 6)} FROM b""",
    "distance_join": f"WITH {_PTS} SELECT id, id2, {_r('d', 'd', 6)} FROM d WHERE d <= 2.0e0",
    "nearest_three": f"WITH {_PTS}, n AS (SELECT id, id2, round(d, 9) AS d FROM d WHERE d <= 4.0e0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d, id2) AS INTEGER) AS rank FROM n) SELECT id, id2, {_r('d', 'd', 6)}, rank FROM r WHERE rank <= 3",
    "mask_difference": f"WITH {_IMG} SELECT y, count(*) AS n FROM img WHERE v > 0.1 AND NOT v > 0.2 GROUP BY y",
    "mask_symmetric_difference": f"WITH {_IMG} SELECT y, count(*) AS n FROM img WHERE (v > 0.1) <> (v < 0.2) GROUP BY y",
    "kmeans_1d": _kmeans_sql(4),
    "gaussian_mixture_1d": _mixture_sql(3, 5),
    "anchor_groups": """WITH RECURSIVE g AS (SELECT user_id, min(value) AS anchor, CAST(0 AS INTEGER) AS grp FROM events GROUP BY user_id
            UNION ALL SELECT g.user_id AS user_id, min(e.value) AS anchor, any_value(g.grp) + 1 AS grp FROM g JOIN events e ON e.user_id = g.user_id AND e.value - g.anchor > 3.0 GROUP BY g.user_id)
        SELECT user_id, max(grp) + 1 AS groups FROM g GROUP BY user_id""",
}
