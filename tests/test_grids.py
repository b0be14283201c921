"""Grids, components, meshes, files and streams on small fixtures with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import colour
from lodestone.operators import connected as C  # noqa: N812
from lodestone.operators import images as I  # noqa: E741, N812
from lodestone.operators import matching, meshes, tomography
from lodestone.operators.ranking import quantiles
from lodestone.sources import files, sinks
from lodestone.streaming import events


def discs(spark, *parts):
    cells = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    hit = F.lit(False)
    for cx, cy, r in parts:
        hit = hit | ((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= r * r)
    return cells.withColumn("v", F.when(hit, 255.0).otherwise(0.0))


def index():
    return F.col("y") * 64 + F.col("x")


def test_two_discs(spark):
    mask = discs(spark, (16, 16, 8), (48, 48, 10)).where("v > 0")
    labelled = C.numbered(C.components(mask, ["x", "y"], index(), 4))
    areas = [tuple(r) for r in labelled.groupBy("label").count().orderBy("label").collect()]
    assert areas == [(1, 197), (2, 317)]
    assert C.largest(labelled).count() == 317
    shape = I.region_shape(labelled, ["label"]).orderBy("label").first()
    assert (shape["area"], shape["cx"], shape["cy"], shape["eccentricity"]) == pytest.approx((197, 16, 16, 0), abs=1e-6)


def test_holes_and_growing(spark):
    cells = discs(spark, (32, 32, 15))
    mask = cells.where("v > 0").where("not (x = 32 and y = 32) and not (x = 33 and y = 32)").select("x", "y")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == 63) | (F.col("y") == 63)
    assert C.fill_holes(mask, cells.select("x", "y"), ["x", "y"], index(), border).count() == 709
    seeds = spark.createDataFrame([(30, 30)], "x int, y int")
    assert C.grow(cells, seeds, lambda v, m: C.within(v, m, "difference", 1.0), ["x", "y"], index(), 4).count() == 709
    assert C.threshold_region(cells, {"x": 1, "y": 1}, None, 10.0, ["x", "y"], index(), 8).count() == 0
    assert C.threshold_region(cells, {"x": 30, "y": 30}, 0.41, None, ["x", "y"], index(), 8).count() == 709


def test_long_chain(spark):
    n = 300
    nodes = spark.range(n).select("id")
    got = C.label_graph(nodes, spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("label = 0").count() == n


def test_morphology_and_agreement(spark):
    mask = discs(spark, (32, 32, 15)).where("v > 0").select("x", "y")
    grown = I.dilate(mask, 64, 64)
    assert I.erode(grown, 64, 64).join(mask, ["x", "y"], "left_semi").count() == 709
    rows = spark.createDataFrame([(False, False)] * 3, "p boolean, a boolean")
    r = I.agreement(rows, F.col("p"), F.col("a")).first()
    assert (r["dice"], r["iou"]) == (1.0, 1.0)


def test_matching(spark):
    points = spark.createDataFrame([(1.0,), (2.5,), (9.0,)], "z double")
    ranges = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 9.0), (3, 9.5, 99.0)], "k int, lo double, hi double")
    assert sorted((r["z"], r["k"]) for r in matching.range_join(points, ranges, "z", "lo", "hi", 2.0).collect()) == [(1.0, 1), (2.5, 2), (9.0, 2)]
    groups = matching.grouped_by_gap(spark.createDataFrame([("a", v) for v in (0.0, 2.0, 4.0, 9.0)], "k string, v double"), ["k"], "v", 3.0)
    assert [r["grp"] for r in groups.orderBy("v").collect()] == [0, 0, 1, 2]


def test_palette_maps_to_itself(spark):
    colours = [(0, 0.9, 0.1, 0.1), (1, 0.1, 0.9, 0.1), (2, 0.1, 0.1, 0.9), (3, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(colours, "entry int, r double, g double, b double")
    rows = p.select(F.col("entry").alias("key"), *[c.alias(n) for c, n in zip(colour.lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a2", "b2"), strict=True)])
    pal = p.select("entry", *[c.alias(n) for c, n in zip(colour.lab(F.col("r"), F.col("g"), F.col("b")), ("pl", "pa", "pb"), strict=True)])
    d = lambda e: colour.delta_e((F.col("l"), F.col("a2"), F.col("b2")), (e["pl"], e["pa"], e["pb"]))
    assert all(r["key"] == r["entry"] and r["distance"] < 1e-9 for r in matching.nearest(rows, pal, d, "entry").collect())


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(k % 3, rng.random()) for k in range(500)] + [(7, 2.5), (8, None)]
    got = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles(spark.createDataFrame(rows, "k int, v double").repartition(5), "v", [0.0, 0.37, 1.0], ["k"]).collect()}
    want = {k: tuple(np.quantile([v for h, v in rows if h == k], [0.0, 0.37, 1.0])) for k in (0, 1, 2, 7)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_bayer(spark):
    cells = spark.range(16).select((F.col("id") % 4).cast("int").alias("x"), (F.col("id") / 4).cast("int").alias("y"))
    got = sorted(r[0] * 16 - 0.5 for r in cells.select(colour.bayer_threshold(F.col("x"), F.col("y"))).collect())
    assert got == list(range(16))


def cube_mesh(spark):
    v = [(k, float(k & 1), float(k >> 1 & 1), float(k >> 2)) for k in range(8)]
    t = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    return spark.createDataFrame(v, "vertex long, x double, y double, z double"), spark.createDataFrame([(k, *x) for k, x in enumerate(t)], "tri long, a long, b long, c long")


def test_unit_cube(spark):
    v, t = cube_mesh(spark)
    assert tuple(meshes.edge_report(t).first()) == (18, 0, 0)
    m = meshes.measures(v, t).first()
    assert (m["area"], abs(m["volume"])) == pytest.approx((6.0, 1.0))
    cut = meshes.layer_lengths(meshes.slices(v, t, spark.createDataFrame([(0.5,)], "z double"), 1.0)).first()
    assert cut["length"] == pytest.approx(4.0)
    assert meshes.weld(v, t, 5.0)[1].count() == 0


def test_em_raises_likelihood(spark):
    m = tomography.system_matrix(spark, 10, 6)
    truth = tomography.ellipses(spark, 10, [(1.0, 0, 0, 0.6, 0.6, 0)])
    sino = tomography.project(m, truth)
    error = lambda image: tomography.project(m, image).join(sino.withColumnRenamed("p", "q"), ["angle", "det"]).agg(F.sum(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert error(tomography.mlem(m, sino, 4)) < 0.4 * error(tomography.mlem(m, sino, 0))
    for subsets in (1, 3):  # packed rays and joins give the same image
        one, other = ({(r["x"], r["y"]): r["v"] for r in fn(m, sino, 2, subsets).collect()} for fn in (tomography._packed_mlem, tomography._joined_mlem))
        assert set(one) == set(other) and all(one[k] == pytest.approx(other[k]) for k in one)


def test_files(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(sinks.pgm_bytes(3, 2, [(1, 0, 7), (2, 1, 255)]))
    cells = {(r["x"], r["y"]): r["v"] for r in files.read_pgm(files.listing(spark, str(tmp_path), "*.pgm")).collect()}
    assert len(cells) == 6 and cells[1, 0] == 7 and cells[2, 1] == 255
    facets = np.arange(24.0).reshape(2, 12)
    (tmp_path / "b.stl").write_bytes(sinks.stl_bytes(facets))
    (tmp_path / "c.stl").write_text("solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid")
    got = files.read_stl(files.listing(spark, str(tmp_path), "*.stl")).orderBy("path", "tri").collect()
    assert [r["nx"] for r in got] == [0.0, 12.0, 0.0] and got[2]["bx"] == 1.0 and got[2]["nz"] == 1.0
    (tmp_path / "d.dcm").write_bytes(b"\0" * 128 + b"DICM")
    assert files.series_folders(files.listing(spark, str(tmp_path))).first()["files"] == 1
    (tmp_path / "e.xml").write_text('<S><PubmedArticle><PMID>1</PMID><ArticleTitle>A <i>b</i></ArticleTitle><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText><LastName>Li</LastName></PubmedArticle></S>')
    a = files.articles(spark, str(tmp_path / "e.xml")).first()
    assert (a["pmid"], a["title"], a["abstract"], a["first_author"]) == ("1", "A b", "AIM: x y", "Li")
    (tmp_path / "f.cube").write_text("TITLE x\nLUT_3D_SIZE 2\n0 0 0\n1 0.5 0\n")
    assert [tuple(r)[1:] for r in files.read_cube(spark, str(tmp_path / "f.cube")).orderBy("index").collect()] == [(0.0, 0.0, 0.0), (1.0, 0.5, 0.0)]
    one = spark.createDataFrame([("1\\x\\2.5", "Dim = 3\nSize = 4 5")], "t string, h string").select(files.numbers_of(F.col("t")), files.header_of(F.col("h"))).first()
    assert one[0] == [1.0, 0.0, 2.5] and one[1] == {"Dim": "3", "Size": "4 5"}


def test_tool_path(spark):
    s = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0, 0.1), (0, 1, 1.0, 0.0, 1.0, 1.0, 0.1), (0, 2, 5.0, 5.0, 6.0, 5.0, 0.1)], "layer int, seq int, x0 double, y0 double, x1 double, y1 double, e double")
    lines = [r["line"] for r in sinks.tool_path(s).collect()]
    assert [x[:2] for x in lines] == ["G0", "G1", "G1", "G0", "G1"] and lines[1] == "G1 X1.000 Y0.000 E0.10000 F1800"


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "6 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("w").select("start", "event_type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, events.windowed(table, "6 hours").select("start", "event_type", "n").collect()))
