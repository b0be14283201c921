"""Writers: tables as CSV and JSON, results and reports, grey maps, surfaces and tool paths."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header, which starts with a byte order mark by default."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def results_document(parts: dict[str, DataFrame], rows: int = 1_000) -> DataFrame:
    """One row with a nested document of small result tables (at most `rows` rows each, else an error)."""
    out = None
    for name, df in parts.items():
        if df.limit(rows + 1).count() > rows:
            raise ValueError(f"{name} has over {rows} rows")
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.join(one)
    return out.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; booleans stay booleans and nulls stay."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(sections: list[tuple[str, DataFrame, int]]) -> str:
    """Markdown of the first rows of small result tables (title, table, rows)."""
    out = []
    for title, df, n in sections:
        rows = df.limit(n).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(f"{x:.4g}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def pgm_bytes(width: int, height: int, cells: list[tuple[int, int, int]]) -> bytes:
    """A binary grey map of cells (x, y, v); the rest is 0."""
    grid = np.zeros((height, width), np.uint8)
    for x, y, v in cells:
        grid[y, x] = v
    return b"P5\n%d %d\n255\n" % (width, height) + grid.tobytes()


def stl_bytes(facets: np.ndarray) -> bytes:
    """A binary surface file of rows (normal, three corners)."""
    out = np.zeros(len(facets), np.dtype([("f", "<f4", 12), ("a", "<u2")]))
    out["f"] = facets
    return b"\0" * 80 + struct.pack("<I", len(facets)) + out.tobytes()


def mask_summary(cells: DataFrame) -> DataFrame:
    """Set cells and their share."""
    return cells.agg(F.count_if(F.col("v") > 0).alias("voxel_count"), (F.count_if(F.col("v") > 0) / F.count("*")).alias("ratio"))


def tool_path(segments: DataFrame, speed: int = 1800) -> DataFrame:
    """One text line for each segment (layer, seq, x0, y0, x1, y1, e): a move where a new path begins, else a drawn line. Ordered by layer and sequence."""
    from pyspark.sql import Window

    w = Window.partitionBy("layer").orderBy("seq")
    starts = F.coalesce((F.lag("x1").over(w) != F.col("x0")) | (F.lag("y1").over(w) != F.col("y0")), F.lit(True))
    travel = F.when(starts, F.printf(F.lit("G0 X%.3f Y%.3f"), F.col("x0"), F.col("y0")))
    draw = F.printf(F.lit("G1 X%.3f Y%.3f E%.5f F%d"), F.col("x1"), F.col("y1"), F.col("e"), F.lit(speed))
    return segments.withColumn("lines", F.array_compact(F.array(travel, draw))).select("layer", "seq", F.posexplode("lines").alias("part", "line")).orderBy("layer", "seq", "part")
