"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize as saved


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds the place (from 0) of each row in the order: rows are dealt by range and sorted in each partition, and the
    partitions' counts (one row each) give the offsets. The dealt rows are saved, so that all uses see one dealing."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id() is the partition's number times 2^33 plus the row's place in the partition.
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    placed = dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return placed.drop("_at", "_part", "_offset")


def quantiles(rows: DataFrame, v: str, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Exact quantiles by key, q0, q1 .. for the shares, linear between neighbours: order statistics by global place, so no
    task holds the values of a key. Nulls are left out."""
    ranked = with_rank(rows.select(*by, F.col(v).cast("double").alias("_v")).where("_v is not null"), *by, "_v", name="_place")
    groups = ranked.groupBy(*by).agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    picks = groups.select("first", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)])).alias("x"))
    place = F.col("x.share") * (F.col("n") - 1)
    low = F.floor(place)
    taps = picks.select(F.col("x.k").alias("_k"), "first", (place - low).alias("part"), low.alias("low"), "n")
    next_ = F.least(F.col("low") + 1, F.col("n") - 1)
    taps = taps.select("_k", F.explode(F.array(F.struct((F.col("first") + F.col("low")).alias("_place"), (1 - F.col("part")).alias("_w")), F.struct((F.col("first") + next_).alias("_place"), F.col("part").alias("_w")))).alias("t")).select("_k", "t._place", "t._w")
    # Places are global, so they name the key's rows too.
    found = ranked.join(F.broadcast(taps), "_place")
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("_k") == k, F.col("_w") * F.col("_v"))).alias(f"q{k}") for k in range(len(shares))])
