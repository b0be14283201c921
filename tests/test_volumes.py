"""Volumes with known markers, supports and slices."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import volumes as V  # noqa: N812


def volume(spark, w, h, d, value):
    cells = spark.range(w * h * d).select((F.col("id") % w).cast("int").alias("x"), (F.floor(F.col("id") / w) % h).cast("int").alias("y"), F.floor(F.col("id") / (w * h)).cast("int").alias("z"))
    return cells.withColumn("v", value)


def test_markers(spark):
    cube = lambda cx, cy: (F.abs(F.col("x") - cx) <= 1) & (F.abs(F.col("y") - cy) <= 1) & (F.abs(F.col("z") - 5) <= 1)
    cells = volume(spark, 32, 32, 10, F.when(cube(8, 16) | cube(24, 16) | cube(16, 8), 2000.0).otherwise(-1000.0))
    got = {r["type"]: (r["grp"], r["x"], r["y"], r["z"]) for r in V.markers(cells, (32, 32, 10), (1.0, 1.0, 2.5)).collect()}
    assert set(got) == {"Left", "Right", "Top", "Center"} and got["Left"] == (0, 8.0, 16.0, 12.5)
    assert got["Center"] == pytest.approx((0, 16.0, 40 / 3, 12.5))


def test_adaptive_region(spark):
    cells = volume(spark, 16, 16, 4, F.greatest(F.lit(0.0), 10 - (F.abs(F.col("x") - 8) + F.abs(F.col("y") - 8)).cast("double")))
    half = 4 * sum(1 for x in range(16) for y in range(16) if 10 - abs(x - 8) - abs(y - 8) >= 5)
    region, weight = V.adaptive_region(cells, {"x": 8, "y": 8, "z": 2}, 16, 16, rounds=6)
    assert 0.5 < weight < 0.75 and 5 <= region.count() <= 0.9 * half


def test_slices(spark):
    rows = spark.createDataFrame([("s", [0.0, 0.0, z], [0.0, 0.0, 1.0]) for z in (0.0, 2.0, 5.0)] + [("one", [0.0, 0.0, 3.0], [0.0, 0.0, 1.0])], "series string, position array<double>, normal array<double>")
    got = dict(map(tuple, V.slice_spacing(V.slice_places(rows, "position", "normal"), ["series"], 1.5).collect()))
    assert got == {"s": 2.5, "one": 1.5}


def test_support_rows(spark):
    cells = volume(spark, 20, 20, 3, F.when((F.col("y") == 15) & F.col("x").between(3, 16), -300.0).otherwise(-1000.0))
    assert {tuple(r) for r in V.support_rows(cells, -500, 10, 19).collect()} == {(z, 15, 14) for z in range(3)}


def test_maps(spark):
    r = spark.range(1).select(V.linear_map(F.lit(3.0), 2.0, 1.0), V.inverse_map(F.lit(7.0), 2.0, 1.0), V.inverse_map(F.lit(7.0), 0.0, 1.0)).first()
    assert tuple(r) == (7.0, 3.0, 0.0)
