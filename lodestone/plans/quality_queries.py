"""Queries of neighbourhood quality measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _IMG, _r, image


def similarity(spark, sf_dir):
    cells = image(spark, sf_dir)
    pairs = cells.select("x", "y", F.col("v").alias("a")).join(cells.select("x", (F.col("y") - 1).alias("y"), F.col("v").alias("b")), ["x", "y"])
    return rounded(Q.structural_similarity(pairs), 6)


def hausdorff(spark, sf_dir):
    cells = image(spark, sf_dir)
    return rounded(Q.hausdorff_95(cells.where("v > 0.3"), cells.where("v < -0.3"), cells), 6)


def jacobian(spark, sf_dir):
    cells = image(spark, sf_dir).where("x < 63")
    other = image(spark, sf_dir).select((F.col("x") - 1).alias("x"), "y", F.col("v").alias("uy"))
    return rounded(Q.jacobian_statistics(cells.withColumnRenamed("v", "ux").join(other, ["x", "y"])), 6)


def landmarks(spark, sf_dir):
    cells = image(spark, sf_dir)
    flow = cells.select("x", "y", F.col("v").alias("ux"), (F.col("v") * 2).alias("uy"))
    at = spark.range(60).select("id", (F.col("id") + 0.25).alias("px"), (F.col("id") * 3 + 0.5).alias("py"), F.col("id").cast("double").alias("tx"), (F.col("id") * 3.0).alias("ty"))
    return rounded(Q.landmark_error(flow, at), 6)


QUERIES = {"structural_similarity": similarity, "hausdorff_95": hausdorff, "jacobian_statistics": jacobian, "landmark_error": landmarks}

ORACLE_SQL = {
    "structural_similarity": f"""WITH {_IMG}, p AS (SELECT a.x AS x, a.y AS y, a.v AS a, b.v AS b FROM img a JOIN img b ON a.x = b.x AND a.y + 1 = b.y),
        q AS (SELECT x, y, {', '.join(f'sum({e}) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS {n}' for n, e in (('ma', 'a'), ('mb', 'b'), ('maa', 'a * a'), ('mbb', 'b * b'), ('mab', 'a * b')))} FROM p),
        r AS (SELECT {', '.join(f'sum({n}) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS {n}' for n in ('ma', 'mb', 'maa', 'mbb', 'mab'))} FROM q)
        SELECT {_r('avg((2 * ma * mb + 1e-4) * (2 * (mab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (maa - ma * ma + mbb - mb * mb + 9e-4)))', 'ssim', 6)} FROM r""",
    "hausdorff_95": f"""WITH {_IMG}, a AS (SELECT x, y FROM img WHERE v > 0.3), b AS (SELECT x, y FROM img WHERE v < -0.3),
        d AS (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a, b GROUP BY a.x, a.y UNION ALL SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FROM a, b GROUP BY b.x, b.y) SELECT {_r('quantile_cont(d, 0.95)', 'hd95', 6)} FROM d""",
    "jacobian_statistics": f"""WITH {_IMG}, f AS (SELECT a.x AS x, a.y AS y, a.v AS ux, b.v AS uy FROM img a JOIN img b ON a.x + 1 = b.x AND a.y = b.y),
        d AS (SELECT (1 + (lead(ux) OVER r - lag(ux) OVER r) / 2) * (1 + (lead(uy) OVER c - lag(uy) OVER c) / 2) - (lead(ux) OVER c - lag(ux) OVER c) / 2 * (lead(uy) OVER r - lag(uy) OVER r) / 2 AS det FROM f WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
        SELECT {_r('avg(det)', 'mean', 6)}, {_r('stddev_samp(det)', 'sd', 6)}, {_r('min(det)', 'lowest', 6)}, {_r('max(det)', 'highest', 6)}, {_r('avg(CASE WHEN det <= 0 THEN 1.0e0 ELSE 0.0e0 END)', 'folding', 6)} FROM d WHERE det IS NOT NULL""",
    "landmark_error": f"""WITH {_IMG}, m AS (SELECT range AS id, 0.75e0 * 0.5e0 * (a.v + c.v) + 0.25e0 * 0.5e0 * (b.v + d.v) AS s FROM range(60) JOIN img a ON a.x = range AND a.y = range * 3 JOIN img b ON b.x = range + 1 AND b.y = range * 3 JOIN img c ON c.x = range AND c.y = range * 3 + 1 JOIN img d ON d.x = range + 1 AND d.y = range * 3 + 1),
        e AS (SELECT sqrt(pow(0.25e0 + s, 2) + pow(0.5e0 + 2 * s, 2)) AS e FROM m) SELECT {_r('avg(e)', 'mean', 6)}, {_r('stddev_pop(e)', 'sd', 6)}, {_r('median(e)', 'median', 6)}, {_r('max(e)', 'highest', 6)}, {_r('min(e)', 'lowest', 6)} FROM e""",
}
