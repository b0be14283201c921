"""Queries of grid operators, with their SQL. The image is `embeddings`: row vec_id, column the place in the vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as I  # noqa: E741, N812
from .evidence_queries import rounded
from .tables import table

WIDTH = 64
PRICE = (0.0, 110_000.0)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.as_grid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("y"), "label", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return cells.withColumn("idx", F.col("y") * WIDTH + F.col("x"))


def region_statistics(spark, sf_dir):
    scaled = labelled(spark, sf_dir).withColumn("v", F.col("v") * 100)
    return rounded(I.region_statistics(scaled, ["label"], cell_volume=0.5), 6)


def labelled_statistics(spark, sf_dir):
    wanted = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return rounded(I.labelled_statistics(labelled(spark, sf_dir), wanted).select("label", "n", "mean", "sd"), 6)


def region_shape(spark, sf_dir):
    return rounded(I.region_shape(labelled(spark, sf_dir).where("v > 0.1"), ["label"]), 6)


def ball_peak(spark, sf_dir):
    cells = image(spark, sf_dir)
    return rounded(I.peak_of_ball_means(cells, cells.where("v > 0.3").select("x", "y"), I.ball_offsets(spark, (2.5, 2.5))), 6)


def projection(spark, sf_dir):
    return rounded(I.projection(image(spark, sf_dir), ["x"]), 6)


def profile(spark, sf_dir):
    return I.profile(image(spark, sf_dir), "y", 0.1)


def best_match(spark, sf_dir):
    cells = image(spark, sf_dir)
    curve = I.best_match(cells, cells.where("y = 7").select("x", "v"), "y", "x")
    return rounded(curve, 6)


def best_match_first(spark, sf_dir):
    cells = image(spark, sf_dir)
    curve = I.best_match(cells, cells.where("y = 7").select("x", "v"), "y", "x")
    return curve.agg(F.max_by("y", F.struct(F.round("ncc", 9), -F.col("y"))).alias("y"), F.round(F.max("ncc"), 6).alias("ncc"))


def parabola(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    return rounded(I.parabola(rows, "q", "n", ["l_linenumber"]), 4)


def histogram(spark, sf_dir):
    return I.full_histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), *PRICE, 256)


def otsu(spark, sf_dir):
    return I.otsu(I.full_histogram(table(spark, sf_dir, "events"), F.least(F.col("value"), F.lit(500.0)), 0.0, 500.0, 256))


def reaching_bin(spark, sf_dir):
    return I.reaching_bin(I.full_histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), *PRICE, 256), 0.7)


def joint_information(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int")).alias("a"), F.floor(F.col("l_extendedprice") / 2000).cast("int").alias("b"))
    return rounded(I.joint_information(li, "a", "b"), 6)


def minmax(spark, sf_dir):
    return rounded(I.normalise(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "minmax", ["c_nationkey"]))


def zscore(spark, sf_dir):
    return rounded(I.normalise(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "zscore", ["c_nationkey"]))


def clip_percentiles(spark, sf_dir):
    return rounded(I.clip_percentiles(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"))


def window_level(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", I.window_level(F.col("p_retailprice"), 1400.0, 700.0, 255.0).alias("z")))


def mask_agreement(spark, sf_dir):
    return rounded(I.agreement(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1))


def class_agreement(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("a"), (F.col("p_partkey") % 5).cast("int").alias("b"))
    return rounded(I.class_agreement(pairs, "a", "b"))


def error_metrics(spark, sf_dir):
    e = labelled(spark, sf_dir)
    pairs = e.join(e.select((F.col("y") - 1).alias("y"), "x", F.col("v").alias("w")), ["y", "x"])
    return rounded(I.error_metrics(pairs, F.col("v"), F.col("w"), 1.0, ["label"]), 6)


def differences(spark, sf_dir):
    return rounded(I.differences(image(spark, sf_dir)).where("g is not null"), 6)


def box_mean(spark, sf_dir):
    return rounded(I.box_mean(image(spark, sf_dir), 3), 6)


def gaussian(spark, sf_dir):
    return rounded(I.weighted_filter(I.weighted_filter(image(spark, sf_dir), [0.25, 0.5, 0.25], "x", "y"), [0.25, 0.5, 0.25], "y", "x"), 6)


def erosion(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").count()
    return I.erode(image(spark, sf_dir).where("v > -0.1"), WIDTH, h)


def dilation(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").count()
    return I.dilate(image(spark, sf_dir).where("v > 0.3"), WIDTH, h)


def square_cases(spark, sf_dir):
    return I.square_cases(image(spark, sf_dir), 0.05).groupBy("case").agg(F.count("*").alias("n"))


QUERIES = {
    "region_statistics": region_statistics, "labelled_statistics": labelled_statistics, "region_shape": region_shape, "ball_mean_peak": ball_peak, "max_projection": projection,
    "threshold_profile": profile, "correlation_curve": best_match, "best_matching_slice": best_match_first, "quadratic_fit": parabola, "histogram_256": histogram, "otsu_threshold": otsu,
    "percentile_bin": reaching_bin, "joint_information": joint_information, "normalise_minmax": minmax, "normalise_zscore": zscore, "clip_percentiles": clip_percentiles,
    "window_level": window_level, "mask_agreement": mask_agreement, "class_agreement": class_agreement, "error_metrics": error_metrics, "central_differences": differences,
    "box_mean": box_mean, "gaussian_filter": gaussian, "erosion": erosion, "dilation": dilation, "marching_square_cases": square_cases,
}

_IMG = "img AS (SELECT y, label, x - 1 AS x, CAST(embedding[x] AS DOUBLE) AS v FROM (SELECT vec_id AS y, label, embedding, unnest(range(1, len(embedding) + 1)) AS x FROM embeddings))"


def _r(sql: str, name: str, digits: int = 8) -> str:
    return f"round({sql}, {digits}) + 0.0e0 AS {name}"


_BIN = "CAST(least(greatest(floor(({0} - {1}) / ({2} - {1}) * {3}), 0), {3} - 1) AS INTEGER)"
_HIST = "hist AS (SELECT CAST(b.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range({bins}) b LEFT JOIN (SELECT {at} AS bin, count(*) AS n FROM {t} GROUP BY 1) h ON b.range = h.bin)"
_PRICE_HIST = _HIST.format(bins=256, at=_BIN.format("l_extendedprice", 0.0, 110000.0, 256), t="lineitem")

ORACLE_SQL = {
    "region_statistics": f"""WITH {_IMG}, c AS (SELECT label, x, y, y * 64 + x AS idx, v * 100 AS v FROM img), t AS (SELECT *, CAST(trunc(v) AS BIGINT) AS w FROM c)
        SELECT label, count(*) AS n, {_r('sum(v)', 'total', 6)}, {_r('avg(v)', 'mean', 6)}, {_r('sqrt(greatest(0.0e0, avg(v * v) - avg(v) * avg(v)))', 'sd', 6)}, min(w) AS lowest, max(w) AS highest,
        arg_min(idx, w * 1000000000 + idx) AS first_lowest, arg_max(idx, w * 1000000000 - idx) AS first_highest, CAST(min(x) AS INTEGER) AS x_min, CAST(max(x) AS INTEGER) AS x_max, min(y) AS y_min, max(y) AS y_max, round(count(*) * 0.5e0, 6) AS volume FROM t GROUP BY label""",
    "labelled_statistics": f"""WITH {_IMG} SELECT CAST(l.range AS INTEGER) AS label, count(v) AS n, {_r('avg(v)', 'mean', 6)}, {_r('CASE WHEN count(v) > 0 THEN sqrt(greatest(0.0e0, avg(v * v) - avg(v) * avg(v))) END', 'sd', 6)} FROM range(12) l LEFT JOIN img ON img.label = l.range GROUP BY 1""",
    "region_shape": f"""WITH {_IMG}, m AS (SELECT label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM img WHERE v > 0.1 GROUP BY label),
        e AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l1, greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0.0e0) AS l2 FROM m)
        SELECT label, area, {_r('cx', 'cx', 6)}, {_r('cy', 'cy', 6)}, CAST(x0 AS INTEGER) AS x0, CAST(x1 AS INTEGER) AS x1, y0, y1, {_r('4 * sqrt(l1)', 'major', 6)}, {_r('4 * sqrt(l2)', 'minor', 6)}, {_r('CASE WHEN l1 > 0 THEN sqrt(1 - l2 / l1) ELSE 0.0e0 END', 'eccentricity', 6)}, {_r('area / CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS DOUBLE)', 'solidity', 6)} FROM e""",
    "ball_mean_peak": f"""WITH {_IMG}, o AS (SELECT a.range AS dx, b.range AS dy FROM range(-2, 3) a, range(-2, 3) b WHERE pow(a.range / 2.5e0, 2) + pow(b.range / 2.5e0, 2) <= 1),
        c AS (SELECT x + dx AS x, y + dy AS y, x AS cx, y AS cy FROM img, o WHERE v > 0.3), m AS (SELECT avg(img.v) AS mean FROM c JOIN img ON c.x = img.x AND c.y = img.y GROUP BY cx, cy) SELECT {_r('max(mean)', 'peak', 6)} FROM m""",
    "max_projection": f"WITH {_IMG} SELECT CAST(x AS INTEGER) AS x, {_r('max(v)', 'v', 6)} FROM img GROUP BY x",
    "threshold_profile": f"WITH {_IMG} SELECT y, count(*) FILTER (v >= 0.1e0) AS n FROM img GROUP BY y",
    "correlation_curve": f"WITH {_IMG} SELECT a.y AS y, {_r('corr(a.v, b.v)', 'ncc', 6)} FROM img a JOIN img b ON a.x = b.x AND b.y = 7 GROUP BY a.y",
    "best_matching_slice": f"WITH {_IMG}, c AS (SELECT a.y AS y, round(corr(a.v, b.v), 9) AS ncc FROM img a JOIN img b ON a.x = b.x AND b.y = 7 GROUP BY a.y) SELECT min(y) AS y, round(max(ncc), 6) AS ncc FROM c WHERE ncc = (SELECT max(ncc) FROM c)",
    "quadratic_fit": f"""WITH p AS (SELECT l_linenumber, l_quantity AS q, CAST(count(*) AS DOUBLE) AS m FROM lineitem GROUP BY 1, 2),
        s AS (SELECT l_linenumber, count(*) AS n, avg(m) AS mm, CAST(count(*) AS DOUBLE) AS s0, sum(q) AS s1, sum(q*q) AS s2, sum(q*q*q) AS s3, sum(q*q*q*q) AS s4, sum(m) AS t0, sum(m*q) AS t1, sum(m*q*q) AS t2 FROM p GROUP BY 1),
        d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS w FROM s)
        SELECT l_linenumber, n, {_r('(t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / w', 'c0', 4)}, {_r('(s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / w', 'c1', 4)}, {_r('(s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / w', 'c2', 4)} FROM d""",
    "histogram_256": f"WITH {_PRICE_HIST} SELECT bin, n FROM hist",
    "otsu_threshold": f"""WITH {_HIST.format(bins=256, at=_BIN.format('least(value, 500.0e0)', 0.0, 500.0, 256), t='events')}, w AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) AS w, CAST(sum(n * bin) OVER (ORDER BY bin) AS DOUBLE) AS m FROM hist),
        a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * bin) AS DOUBLE) AS s FROM hist), b AS (SELECT bin, pow(m * n - s * w, 2) / (w * (n - w)) AS between_ FROM w, a WHERE w > 0 AND w < n) SELECT min(bin) AS threshold FROM b WHERE between_ = (SELECT max(between_) FROM b)""",
    "percentile_bin": f"WITH {_PRICE_HIST}, c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM hist) SELECT min(bin) AS bin FROM c WHERE c > 0.7e0 * t",
    "joint_information": f"""WITH p AS (SELECT CAST(trunc(l_quantity) AS INTEGER) AS a, CAST(floor(l_extendedprice / 2000) AS INTEGER) AS b FROM lineitem), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM p), j AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
        ea AS (SELECT sum(-n / t * ln(n / t)) AS ha FROM (SELECT sum(n) AS n FROM j GROUP BY a), t), eb AS (SELECT sum(-n / t * ln(n / t)) AS hb FROM (SELECT sum(n) AS n FROM j GROUP BY b), t), ej AS (SELECT sum(-n / t * ln(n / t)) AS hab FROM j, t)
        SELECT {_r('ha', 'ha', 6)}, {_r('hb', 'hb', 6)}, {_r('hab', 'hab', 6)}, {_r('ha + hb - hab', 'mi', 6)}, {_r('(ha + hb) / (hab + 1e-10)', 'nmi', 6)} FROM ea, eb, ej""",
    "normalise_minmax": f"SELECT c_custkey, c_nationkey, {_r('c_acctbal', 'c_acctbal')}, {_r('CASE WHEN max(c_acctbal) OVER w - min(c_acctbal) OVER w > 1e-8 THEN (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) ELSE 0.0e0 END', 'z')} FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "normalise_zscore": f"SELECT c_custkey, c_nationkey, {_r('c_acctbal', 'c_acctbal')}, {_r('CASE WHEN stddev_pop(c_acctbal) OVER w > 1e-8 THEN (c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w ELSE 0.0e0 END', 'z')} FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "clip_percentiles": f"WITH e AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders) SELECT o_orderkey, {_r('o_totalprice', 'o_totalprice')}, {_r('CASE WHEN hi - lo > 1e-8 THEN (least(greatest(o_totalprice, lo), hi) - lo) / (hi - lo) ELSE 0.0e0 END', 'z')} FROM orders, e",
    "window_level": f"SELECT p_partkey, {_r('least(greatest((p_retailprice - 1050.0e0) / 700.0e0, 0.0e0), 1.0e0) * 255', 'z')} FROM part",
    "mask_agreement": f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
        SELECT tp, fp, fn, tn, {_r('2.0e0 * tp / (2 * tp + fp + fn)', 'dice')}, {_r('tp / CAST(tp + fp + fn AS DOUBLE)', 'iou')}, {_r('(2.0e0 * tp + 1e-5) / (2 * tp + fp + fn + 1e-5)', 'dice_smooth')}, {_r('tp / (tp + fn + 1e-8)', 'sensitivity')}, {_r('tn / (tn + fp + 1e-8)', 'specificity')} FROM c""",
    "class_agreement": f"""WITH p AS (SELECT p_size % 5 AS a, CAST(p_partkey % 5 AS INTEGER) AS b FROM part), k AS (SELECT DISTINCT a AS class FROM p UNION SELECT DISTINCT b FROM p),
        c AS (SELECT class, count(*) FILTER (a = class AND b = class) AS tp, count(*) FILTER (a = class AND b <> class) AS fp, count(*) FILTER (a <> class AND b = class) AS fn FROM p, k GROUP BY class)
        SELECT class, tp, fp, fn, {_r('CASE WHEN tp + fp + fn = 0 THEN 1.0e0 ELSE 2.0e0 * tp / (2 * tp + fp + fn) END', 'dice')}, {_r('CASE WHEN tp + fp + fn = 0 THEN 1.0e0 ELSE tp / CAST(tp + fp + fn AS DOUBLE) END', 'iou')} FROM c""",
    "error_metrics": f"WITH {_IMG}, m AS (SELECT a.label AS label, avg(pow(a.v - b.v, 2)) AS mse, corr(a.v, b.v) AS ncc FROM img a JOIN img b ON a.y + 1 = b.y AND a.x = b.x GROUP BY a.label) SELECT label, {_r('mse', 'mse', 6)}, {_r('ncc', 'ncc', 6)}, {_r('10 * log10(1 / mse)', 'psnr', 6)} FROM m",
    "central_differences": f"""WITH {_IMG}, d AS (SELECT x, y, v, (lead(v) OVER r - lag(v) OVER r) / 2 AS gx, (lead(v) OVER c - lag(v) OVER c) / 2 AS gy FROM img WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
        SELECT CAST(x AS INTEGER) AS x, y, {_r('v', 'v', 6)}, {_r('gx', 'gx', 6)}, {_r('gy', 'gy', 6)}, {_r('sqrt(gx * gx + gy * gy)', 'g', 6)} FROM d WHERE gx IS NOT NULL AND gy IS NOT NULL""",
    "box_mean": f"""WITH {_IMG}, a AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS v FROM img) SELECT CAST(x AS INTEGER) AS x, y, {_r('sum(v) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7', 'v', 6)} FROM a""",
    "gaussian_filter": f"""WITH {_IMG}, a AS (SELECT x, y, 0.25e0 * coalesce(lag(v) OVER w, v) + 0.5e0 * v + 0.25e0 * coalesce(lead(v) OVER w, v) AS v FROM img WINDOW w AS (PARTITION BY y ORDER BY x))
        SELECT CAST(x AS INTEGER) AS x, y, {_r('0.25e0 * coalesce(lag(v) OVER w, v) + 0.5e0 * v + 0.25e0 * coalesce(lead(v) OVER w, v)', 'v', 6)} FROM a WINDOW w AS (PARTITION BY x ORDER BY y)""",
    "erosion": f"""WITH {_IMG}, m AS (SELECT x, y FROM img WHERE v > -0.1), h AS (SELECT count(*) AS h FROM embeddings)
        SELECT CAST(x AS INTEGER) AS x, y FROM m, h WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND h - 2 AND (SELECT count(*) FROM m b WHERE abs(b.x - m.x) + abs(b.y - m.y) = 1) = 4""",
    "dilation": f"""WITH {_IMG}, m AS (SELECT x, y FROM img WHERE v > 0.3), h AS (SELECT count(*) AS h FROM embeddings), o(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
        g AS (SELECT x + dx AS x, y + dy AS y FROM m, o) SELECT DISTINCT CAST(x AS INTEGER) AS x, y FROM (SELECT x, y FROM m UNION ALL SELECT x, y FROM g, h WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND h - 2)""",
    "marching_square_cases": f"""WITH {_IMG}, b AS (SELECT x, y, CASE WHEN v >= 0.05e0 THEN 1 ELSE 0 END AS b FROM img)
        SELECT p.b + 2 * q.b + 4 * r.b + 8 * s.b AS "case", count(*) AS n FROM b p JOIN b q ON q.x = p.x + 1 AND q.y = p.y JOIN b r ON r.x = p.x + 1 AND r.y = p.y + 1 JOIN b s ON s.x = p.x AND s.y = p.y + 1 GROUP BY 1""",
}
ORACLE_SQL["erosion"] = f"""WITH {_IMG}, m AS (SELECT x, y FROM img WHERE v > -0.1), h AS (SELECT count(*) AS h FROM embeddings), o(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
    n AS (SELECT m.x AS x, m.y AS y, count(*) AS n FROM m CROSS JOIN o JOIN m b ON b.x = m.x + dx AND b.y = m.y + dy GROUP BY 1, 2) SELECT CAST(x AS INTEGER) AS x, y FROM n, h WHERE n = 4 AND x BETWEEN 1 AND 62 AND y BETWEEN 1 AND h - 2"""
