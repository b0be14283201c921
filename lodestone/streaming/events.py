"""Structured Streaming over an event table (an extension: grid work has no unbounded sources of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and sums by key and window; rows later than `late` are dropped on a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Runs of events of a key without a pause over `gap`."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total")


def merged_patches(cells: DataFrame, width: int, size: int, step: int, score) -> DataFrame:
    """Overlapping windows along x, scored cell by cell and merged by weight (largest in a window's middle)."""
    starts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("x") - size + step) / step).cast("int")) * step, F.least(F.floor(F.col("x") / step).cast("int") * step, F.lit(width - size)), F.lit(step))
    each = cells.withColumn("start", F.explode(starts)).where((F.col("x") >= F.col("start")) & (F.col("x") < F.col("start") + size))
    middle = 1 - F.abs(F.col("x") - F.col("start") - (size - 1) / 2) / size
    return each.withColumns({"p": score(F.col("v"), F.col("start")), "w": middle}).groupBy("x", "y").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
