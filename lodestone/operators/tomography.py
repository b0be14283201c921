"""Projection and iterative reconstruction as joins with a sparse system matrix (ray, pixel, weight).

A ray's samples are spread to the four pixels round each (bilinear weights). Projecting is a join with the image and a
sum by ray, back-projecting a join with the sinogram and a sum by pixel; a reconstruction repeats both, with the image
saved after each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import saved

#: Cells of an image that is sent to all tasks and held by the driver at most.
IN_MEMORY = 1 << 20
#: Bytes that all tasks of a round together send back at most (two numbers a cell and task).
SENT = 64 << 20


def system_matrix(spark: SparkSession, size: int, angles: int) -> DataFrame:
    """(angle, det, x, y, w) for parallel rays over 180 degrees, one detector a pixel, samples one pixel apart, the centre at (size - 1) / 2."""
    c = (size - 1) / 2
    rays = spark.range(angles * size * size).select((F.col("id") / (size * size)).cast("int").alias("angle"), (F.col("id") / size % size).cast("int").alias("det"), (F.col("id") % size).cast("int").alias("k"))
    t = F.col("angle") * (math.pi / angles)
    s, u = F.col("det") - c, F.col("k") - c
    at = rays.select("angle", "det", (s * F.cos(t) - u * F.sin(t) + c).alias("px"), (s * F.sin(t) + u * F.cos(t) + c).alias("py"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    taps = F.explode(F.array(*[F.struct((F.floor("px") + dx).cast("int").alias("x"), (F.floor("py") + dy).cast("int").alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dx in (0, 1) for dy in (0, 1)]))
    flat = at.select("angle", "det", taps.alias("t")).select("angle", "det", "t.x", "t.y", "t.w")
    return flat.where(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1) & (F.col("w") > 0)).groupBy("angle", "det", "x", "y").agg(F.sum("w").alias("w"))


def project(matrix: DataFrame, image: DataFrame) -> DataFrame:
    return matrix.join(image, ["x", "y"]).groupBy("angle", "det").agg(F.sum(F.col("w") * F.col("v")).alias("p"))


def back_project(matrix: DataFrame, sinogram: DataFrame) -> DataFrame:
    return matrix.join(sinogram, ["angle", "det"]).groupBy("x", "y").agg(F.sum(F.col("w") * F.col("p")).alias("v"))


def mlem(matrix: DataFrame, sinogram: DataFrame, rounds: int, subsets: int = 1) -> DataFrame:
    """Maximum-likelihood EM (with subsets of angles: OSEM) from an image of ones; sensitivities are at least 1e-10. An image
    of up to IN_MEMORY cells is sent to the rays, which are packed by angle; a larger one is joined with them."""
    matrix = saved(matrix)
    if matrix.select("x", "y").distinct().limit(IN_MEMORY + 1).count() <= IN_MEMORY:
        return _packed_mlem(matrix, sinogram, rounds, subsets)
    return _joined_mlem(matrix, sinogram, rounds, subsets)


_PACKED = "angle int, ray binary, pixel binary, w binary, m binary"


def _pack(width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        det, x, y, w, m = (rows[c].to_numpy() for c in ("det", "x", "y", "w", "m"))
        kinds, ray = np.unique(det, return_inverse=True)
        counts = np.zeros(len(kinds))
        counts[ray] = m
        blobs = [ray.astype(np.int32), (y.astype(np.int64) * width + x).astype(np.int32), w.astype(float), counts]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["angle", "ray", "pixel", "w", "m"])

    return run


def _packed_mlem(matrix: DataFrame, sinogram: DataFrame, rounds: int, subsets: int) -> DataFrame:
    spark = matrix.sparkSession
    width, height = (n or 0 for n in matrix.agg(F.max("x") + 1, F.max("y") + 1).first())
    known = matrix.select((F.col("y") * width + F.col("x")).alias("pixel")).distinct().toPandas()["pixel"].to_numpy()
    rays = matrix.join(sinogram.select("angle", "det", F.col("p").alias("m")), ["angle", "det"])
    image = np.ones(width * height)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, SENT // (16 * max(1, len(image)))))
    packed = saved(rays.groupBy("angle").applyInArrow(_pack(width), _PACKED).repartition(tasks, "angle"))

    def gather(held):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            image = held.value
            back, seen = np.zeros(len(image)), np.zeros(len(image))
            for batch in batches:
                for blobs in zip(*(batch[c] for c in ("ray", "pixel", "w", "m")), strict=True):
                    ray, pixel, w, m = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.int32, np.int32, float, float), strict=True))
                    p = np.bincount(ray, w * image[pixel], len(m))
                    ratio = np.divide(m, p, out=np.zeros(len(m)), where=p > 1e-10)
                    back += np.bincount(pixel, w * ratio[ray], len(image))
                    seen += np.bincount(pixel, w, len(image))
            yield pa.RecordBatch.from_arrays([pa.array([back.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["b", "s"])

        return run

    for _ in range(rounds):
        for s in range(subsets):
            part = packed.where(F.col("angle") % subsets == s) if subsets > 1 else packed
            held = spark.sparkContext.broadcast(image)
            got = part.coalesce(tasks).mapInArrow(gather(held), "b binary, s binary").collect()
            back, seen = (sum((np.frombuffer(r[k]) for r in got), np.zeros(len(image))) for k in ("b", "s"))
            image = np.where(seen > 0, image * back / np.maximum(seen, 1e-10), image)
            held.destroy()
    return spark.createDataFrame(pd.DataFrame({"x": (known % max(width, 1)).astype(np.int32), "y": (known // max(width, 1)).astype(np.int32), "v": image[known]}), "x int, y int, v double")


def _joined_mlem(matrix: DataFrame, sinogram: DataFrame, rounds: int, subsets: int) -> DataFrame:
    pixels = matrix.select("x", "y").distinct()
    image = pixels.withColumn("v", F.lit(1.0))
    for r in range(rounds):
        for s in range(subsets):
            part = matrix.where(F.col("angle") % subsets == s) if subsets > 1 else matrix
            ratio = project(part, image).join(sinogram.withColumnRenamed("p", "m"), ["angle", "det"]).select("angle", "det", F.when(F.col("p") > 1e-10, F.col("m") / F.col("p")).otherwise(0.0).alias("p"))
            sums = part.join(ratio, ["angle", "det"]).groupBy("x", "y").agg(F.sum(F.col("w") * F.col("p")).alias("b"), F.sum("w").alias("s"))
            image = saved(image.join(sums, ["x", "y"], "left").select("x", "y", F.coalesce(F.col("v") * F.col("b") / F.greatest("s", F.lit(1e-10)), "v").alias("v")))
    return image


def sirt(matrix: DataFrame, sinogram: DataFrame, rounds: int, relax: float = 1.0) -> DataFrame:
    """Simultaneous iterative reconstruction from zero, clamped at zero."""
    matrix = saved(matrix)
    rows, cols = matrix.groupBy("angle", "det").agg(F.sum("w").alias("rw")), matrix.groupBy("x", "y").agg(F.sum("w").alias("cw"))
    image = cols.select("x", "y", F.lit(0.0).alias("v"))
    for _ in range(rounds):
        rest = project(matrix, image).join(sinogram.withColumnRenamed("p", "m"), ["angle", "det"]).join(rows, ["angle", "det"]).select("angle", "det", ((F.col("m") - F.col("p")) / F.col("rw")).alias("p"))
        step = back_project(matrix, rest).withColumnRenamed("v", "b")
        image = saved(image.join(step, ["x", "y"]).join(cols, ["x", "y"]).select("x", "y", F.greatest(F.lit(0.0), F.col("v") + relax * F.col("b") / F.col("cw")).alias("v")))
    return image


def ellipses(spark: SparkSession, size: int, parts: list[tuple[float, float, float, float, float, float]]) -> DataFrame:
    """A phantom: the sum of intensities of ellipses (intensity, cx, cy, a, b, theta in degrees) in coordinates -1 .. 1."""
    cells = spark.range(size * size).select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    u, w = (2 * F.col("x") - size + 1) / size, (2 * F.col("y") - size + 1) / size
    v = F.lit(0.0)
    for i, cx, cy, a, b, t in parts:
        c, s = math.cos(math.radians(t)), math.sin(math.radians(t))
        p, q = (u - cx) * c + (w - cy) * s, (w - cy) * c - (u - cx) * s
        v = v + F.when(p * p / (a * a) + q * q / (b * b) <= 1, i).otherwise(0.0)
    return cells.withColumn("v", v)
