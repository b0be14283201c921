"""Queries over events and files-like text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..streaming import events as S  # noqa: N812
from .evidence_queries import rounded
from .image_queries import _IMG, _r, image
from .tables import table


def tumbling(spark, sf_dir):
    return rounded(S.windowed(table(spark, sf_dir, "events"), "6 hours").select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total"), 4)


def sliding(spark, sf_dir):
    return rounded(S.windowed(table(spark, sf_dir, "events"), "12 hours", "6 hours").select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total"), 4)


def sessions(spark, sf_dir):
    return rounded(S.sessions(table(spark, sf_dir, "events"), "4 hours").select(F.unix_timestamp("start").alias("start"), "user_id", "n", "total"), 4)


def patches(spark, sf_dir):
    return rounded(S.merged_patches(image(spark, sf_dir), 64, 16, 8, lambda v, start: v * (1 + start / 64)), 6)


def cube(spark, sf_dir):
    """Lines by flag and status with all subtotals."""
    return rounded(table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 4)


def props(spark, sf_dir):
    """Events by the first key of their JSON properties."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").groupBy(F.element_at(F.array_sort(keys), 1).alias("key")).agg(F.count("*").alias("n"))


def stems(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/data/case_"), F.col("p_partkey") % 50, F.lit("_000"), F.col("p_size") % 3, F.lit(".nii.gz")).alias("path"))
    return rows.groupBy(files.stem_of(F.col("path")).alias("stem")).agg(F.count("*").alias("n"))


def top_prices(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(15)


QUERIES = {"tumbling_windows": tumbling, "sliding_windows": sliding, "session_windows": sessions, "merged_patches": patches, "cube_totals": cube, "json_keys": props, "case_stems": stems, "top_prices": top_prices}

ORACLE_SQL = {
    "tumbling_windows": f"SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, event_type, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM events GROUP BY 1, 2",
    "sliding_windows": f"SELECT (CAST(floor(epoch(ts) / 21600) AS BIGINT) - k.range) * 21600 AS start, event_type, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM events, range(2) k GROUP BY 1, 2",
    "session_windows": f"""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 4 HOURS THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM g) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM s GROUP BY user_id, sid""",
    "merged_patches": f"WITH {_IMG}, p AS (SELECT x, y, v, s.range AS start FROM img, range(0, 49, 8) s WHERE x >= s.range AND x < s.range + 16), w AS (SELECT x, y, v * (1 + start / 64.0e0) AS p, 1 - abs(x - start - 7.5e0) / 16 AS w FROM p) SELECT CAST(x AS INTEGER) AS x, y, {_r('sum(w * p) / sum(w)', 'p', 6)} FROM w GROUP BY x, y",
    "cube_totals": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_r('sum(l_quantity)', 'quantity', 4)} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "json_keys": "SELECT list_sort(json_keys(props))[1] AS key, count(*) AS n FROM events GROUP BY 1",
    "case_stems": "SELECT 'case_' || (p_partkey % 50) AS stem, count(*) AS n FROM part GROUP BY 1",
    "top_prices": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15",
}
