"""Queries over whole tables, held against brute force."""

import bisect
import math
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import connected, matching, quality

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet").column(c).to_pylist() for c in columns), strict=True))


def test_threshold_region_goes_on_below_row_99(spark, tmp_path):
    """A line from the seed that turns at row 140, and another one that doesn't touch it."""
    want = {(12, y) for y in range(40, 141)} | {(x, 140) for x in range(13, 20)}
    high = want | {(30, y) for y in range(150)}
    rows = [(y, [1.0 if (x, y) in high else -1.0 for x in range(64)]) for y in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in entry.queries()["threshold_region"](spark, str(tmp_path)).collect()} == want


def test_all_suppliers_bracket(spark):
    sums = defaultdict(list)
    for s, q, p in read("lineitem", "l_suppkey", "l_quantity", "l_extendedprice"):
        sums[s, q].append(p)
    knots = {k: sum(v) / len(v) for k, v in sums.items()}
    by = defaultdict(list)
    for s, q in sorted(knots):
        by[s].append(q)
    got = {(r["l_suppkey"], r["q"]): r["price"] for r in entry.queries()["bracketing_join"](spark, SF).collect()}
    assert set(got) == {(s, q) for s in by for q in {q for _, q in knots}}
    for (s, q), price in got.items():
        at = bisect.bisect_left(by[s], q)
        lo, hi = by[s][max(at - (at == len(by[s]) or by[s][at] > q), 0)], by[s][min(at, len(by[s]) - 1)]
        share = (q - lo) / (hi - lo) if hi > lo else 0
        assert price == pytest.approx(knots[s, lo] + share * (knots[s, hi] - knots[s, lo]), abs=1e-3)


def test_all_suppliers_are_the_palette(spark):
    palette = read("supplier", "s_suppkey", "s_acctbal")
    want = {c: min((abs(b - v), s) for s, v in palette) for c, b in read("customer", "c_custkey", "c_acctbal")}
    got = {r[0]: (r[2], r[1]) for r in entry.queries()["nearest_palette"](spark, SF).collect()}
    assert got == {c: (pytest.approx(d, abs=1e-6), s) for c, (d, s) in want.items()}


def test_nearest_on_line(spark):
    palette = [(70_000 - k, float(k // 2 * 3)) for k in range(70_000)] + [(1, None)]
    rows = [(k, float(k * 37 % 110_000)) for k in range(3000)] + [(k, 6.0) for k in range(3000, 4000)] + [(4000, None), (4001, -5.0), (4002, 1.5)]
    entries = {}
    for i, v in palette[:-1]:
        entries[v] = min(i, entries.get(v, i))
    places = sorted(entries)
    want = {}
    for k, v in rows:
        at = bisect.bisect_left(places, v) if v is not None else 0
        want[k] = min((abs(v - p), entries[p]) for p in places[max(at - 1, 0) : at + 1]) if v is not None else (None, None)
    got = matching.nearest_on_line(spark.createDataFrame(rows, "id long, at double").repartition(3), spark.createDataFrame(palette, "entry long, at double"), "id", "at", "entry").collect()
    assert len(got) == len(rows) and {r["id"]: (r["distance"], r["entry"]) for r in got} == want
    none = matching.nearest_on_line(spark.createDataFrame(rows[:3], "id long, at double"), spark.createDataFrame([], "entry long, at double"), "id", "at", "entry").collect()
    assert [r["entry"] for r in none] == [None] * 3


def test_one_key_over_many_ranges(spark):
    """Nearly all rows have one key; its values are carried from range to range both ways."""
    left = [(0 if k % 50 else 1 + k % 3, float(k * 7 % 4001)) for k in range(3000)] + [(9, 1.0), (None, 2.0)]
    right = [(0, float(k * 400), k) for k in range(1, 9)] + [(1, 5.0, 77)]
    a, b = spark.createDataFrame(left, "k int, t double"), spark.createDataFrame(right, "k int, t double, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        last = matching.as_of(a, b, ["k"], "t", ["v"]).collect()
        line = matching.bracket(a, b.select("k", "t", (b["v"] * 10.0).alias("y")), ["k"], "t", "y").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(last) == len(line) == len(left)
    for r in last:
        before = [(t, v) for k, t, v in right if k == r["k"] and t <= r["t"]]
        assert r["r_v"] == (max(before)[1] if before else None)
    for r in line:
        knots = sorted((t, v * 10.0) for k, t, v in right if k == r["k"])
        if not knots:
            assert r["y"] is None
            continue
        lo, hi = max((x for x in knots if x[0] <= r["t"]), default=knots[0]), min((x for x in knots if x[0] >= r["t"]), default=knots[-1])
        assert r["y"] == pytest.approx(lo[1] + ((r["t"] - lo[0]) / (hi[0] - lo[0]) if hi[0] > lo[0] else 0) * (hi[1] - lo[1]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_not_broadcast(spark):
    """What Spark takes for small, as its file is, has many rows when it is read or exploded."""
    cells = spark.range(400).select("id", (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"))
    edges = connected.grid_edges(cells, ["x", "y"], 4)
    assert edges.count() == 2 * 19 * 20
    assert "Broadcast" not in plan(edges)


def test_distance_join_is_not_broadcast(spark):
    assert "Broadcast" not in plan(entry.queries()["distance_join"](spark, SF))


def test_nearest_three_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "within_distance", None)
    points = [(i, float(size), price / 20, float(i % 40)) for i, size, price in read("part", "p_partkey", "p_size", "p_retailprice")]
    want = []
    for i, *p in points:
        near = sorted((round(d, 9), j) for j, *q in points if j != i and (d := math.dist(p, q)) <= 4)
        want += [(i, j, pytest.approx(d, abs=2e-6), r) for r, (d, j) in enumerate(near[:3], 1)]
    assert sorted((tuple(r) for r in entry.queries()["nearest_three"](spark, SF).collect()), key=lambda r: (r[0], r[3])) == want


def test_nearest_within_at_one_place(spark):
    """Many points at one place, ties, a point alone, one at the radius and one without a place."""
    points = [(k, 1.0, 1.0, 1.0) for k in range(50, 0, -1)] + [(100 + k, 2.0 + k % 2, 1.0, 1.0) for k in range(4)] + [(200, 90.0, 0.0, 0.0), (201, -3.0, 1.0, 1.0), (202, 40.0, 0.0, 0.0), (203, 44.0, 0.0, 0.0), (204, None, 0.0, 0.0)]
    want = []
    for i, *p in sorted(points):
        near = sorted((round(d, 9), j) for j, *q in points if j != i and None not in (*p, *q) and (d := math.dist(p, q)) <= 4)
        want += [(i, j, d, r) for r, (d, j) in enumerate(near[:3], 1)]
    got = matching.nearest_within(spark.createDataFrame(points, "id long, x double, y double, z double"), 4.0, 3, 9)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[3])) == want


def test_surface_distances_read_each_column_once(spark):
    cells = spark.range(30).select((F.col("id") % 3).alias("x"), F.floor(F.col("id") / 3).alias("y"))
    found = quality.squared_distances(cells, cells.where("x = 1 and y in (2, 7)"), cells)
    assert {(r["x"], r["y"]): r["d2"] for r in found.collect()} == {(x, y): min((x - 1) ** 2 + (y - b) ** 2 for b in (2, 7)) for x in range(3) for y in range(10)}
    assert "unboundedfollowing" not in plan(found)
