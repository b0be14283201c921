"""Sharding by jump consistent hashing.

A stable key and the number of shards alone decide a row's shard; there is no ring table, and with one more shard a
row either stays or moves to the new shard. Slots inside a shard are gapless: rows are dealt out as ranges of shard, key
and a random number, so that not even one key with very many rows makes a large range; rows are numbered inside each
range, and the counts of ranges and shards (one row for each of both at most) give the offsets.

Defined results: a null key is a key of its own (as -1); a null text has size 16 and checksum 0; rows that repeat a key
share a shard and get different slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Constants of the published jump hash (fixed values).
LCG = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, by the jump consistent hash of Lamping and Veach."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    live, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(live):
        shard[live] = at
        key = key * np.uint64(LCG) + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        more = at < shards
        live, at, key = live[more], at[more], key[more]
    return shard


def _sharder(shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(common.mix(keys.to_numpy(np.int64).view(np.uint64)), shards).astype(np.int32))

    return shard


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard (the shard with one shard more)."""
    key = F.coalesce(F.col("id"), F.lit(-1).cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(
        "id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = base.select("*", _sharder(shards)(key).alias("shard"), _sharder(shards + 1)(key).alias("grown_shard"), F.rand(7).alias("tie"))
    order = [F.col("shard"), F.col("id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # Saved, so that counts and numbers are of one dealing. The number is the range's times 2^33 plus the place in it.
    dealt = common.materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftrightunsigned("at", 33)))
    counts = dealt.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")
    offsets = counts.select("shard", "range", (before - F.col("first")).alias("offset"))
    return dealt.join(F.broadcast(offsets), ["shard", "range"]).select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).alias("slot"), "grown_shard")
