"""Blocked Bloom filters as DataFrame expressions.

A filter has blocks of eight 64-bit words; a hash names a block and one bit of each word. It is built with `bit_or` by
block and holds at most MAX_BLOCKS blocks (64 bytes each), so what is broadcast is bounded however many keys there are;
more keys only let more rows through, and an exact join always follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 16
KEYS_A_BLOCK = 40


def _bits(h: Column) -> list[Column]:
    """One bit for each word of a block, from independent hashes of the key's hash."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h, F.lit(k)), F.lit(64)).cast("int")) for k in range(8)]


def blocks_of(keys: DataFrame, h: Column, blocks: int, at: str, words: list[str]) -> DataFrame:
    """The blocks of the filter that have a bit set: where, and the eight words."""
    rows = keys.select(F.pmod(h, F.lit(blocks)).alias(at), *[b.alias(w) for w, b in zip(words, _bits(h), strict=True)])
    return rows.groupBy(at).agg(*[F.bit_or(w).alias(w) for w in words])


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def marked(df: DataFrame, h: Column, keys: DataFrame, key_h: Column, flag: str, blocks: int | None = None) -> DataFrame:
    """df with the column `flag`: false only for rows whose hash surely isn't among the keys' hashes."""
    blocks = blocks or min(MAX_BLOCKS, max(1, -(-keys.count() // KEYS_A_BLOCK)))
    at, words = unused(df, "block"), [unused(df, f"w{k}") for k in range(8)]
    found = df.withColumn(at, F.pmod(h, F.lit(blocks))).join(F.broadcast(blocks_of(keys, key_h, blocks, at, words)), at, "left")
    hit = F.lit(True)
    for word, bit in zip(words, _bits(h), strict=True):
        hit = hit & (F.col(word).bitwiseAND(bit) == bit)
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(at, *words)


def without_rows(docs: DataFrame, id_col: str, marks: DataFrame, marking: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs, with their columns, less those that `marks` names: `gone` (an id or null), `mark` (what tells the
    rows of one id apart) and `stays` (whether one row of this id and mark stays, or none). Marks must hold each id and
    mark that several rows have, so that any others are one row each. marking(rows, name) adds the mark to rows under
    that name; rows whose mark is null stay. Only rows whose id the filter can't clear are marked and shuffled."""
    flag, mark = unused(docs, "maybe"), unused(docs, "mark")
    rows = marked(docs, F.xxhash64(F.col(id_col).cast("long")), marks, F.xxhash64("gone"), flag)
    possible = marking(rows.where(F.col(flag)).drop(flag), mark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = possible.where(F.col(mark).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"), F.col(mark).alias("mark")).agg(F.first(whole).alias("row"))
    gone = marks.where("not stays").select("gone", F.col("mark").alias("of"))
    left = one.join(gone, one["id"].eqNullSafe(gone["gone"]) & (one["mark"] == gone["of"]), "left_anti").select("row.*")
    return rows.where(~F.col(flag)).drop(flag).unionByName(possible.where(F.col(mark).isNull()).drop(mark)).unionByName(left)
