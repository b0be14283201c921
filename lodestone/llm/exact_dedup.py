"""Exact deduplication by content sort.

Sampled splitters deal the normalised texts out as ranges, an external sort puts the bytes of each range in order, and
each text is compared in full with its neighbour. A splitter is (first KEY_CHARS characters, 64-bit hash, id), so that it
stays short however long the texts are and a group of equal texts of any size can be cut between ranges. Runs at the
ends of a range, two at most, are compared in full with those of the other ranges.

Defined results: a null text counts as empty; rows with equal text and equal id are separate rows of the group, of
which one stays; null ids sort last, so `keep_id` is null only if every id of the group is; an empty table gives no
rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

KEY_CHARS = 48
SPACE = r"[ \t\n\x0B\f\r]+"
_RUNS = pa.schema([("id", pa.int64()), ("sha", pa.binary()), ("run_min", pa.int64()), ("run_size", pa.int64()), ("head", pa.bool_()), ("part", pa.int32()), ("side", pa.int32()), ("text", pa.binary())])


def normalised(text):
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sha(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each run of equal texts is given with its smallest id and size. A run at an end of the range has
    a side (0 or 1), and its first row the text."""
    part = TaskContext.get().partitionId()
    out = common.Sink(_RUNS)

    def flush(ids: list, text: bytes, side: int | None) -> None:
        n, sha = len(ids), hashlib.sha256(text).digest()
        out.add(n, ids, [sha] * n, [ids[0]] * n, [n] * n, [True] + [False] * (n - 1), [part] * n, [side] * n, [None if side is None else text] + [None] * (n - 1))

    ids: list = []
    last = None
    side: int | None = 0
    for id_, text in common.rows_of(batches, "id", "text"):
        if ids and text == last:
            ids.append(id_)
            continue
        if ids:
            flush(ids, last, side)
            side = None
            yield from out.full()
        ids, last = [id_], text
    if ids:
        flush(ids, last, 0 if side == 0 else 1)
    yield from out.rest()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (binary SHA-256 of the normalised text)."""
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"))
    keyed = norm.select("id", F.col("text").cast("binary").alias("text"), F.substring("text", 1, KEY_CHARS).alias("key"), F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(F.col("key"), F.col("h"), F.col("id").asc_nulls_last()).select("id", "text")
    runs = common.materialize(dealt.sortWithinPartitions(F.col("text"), F.col("id").asc_nulls_last()).mapInArrow(_runs, "id long, sha binary, run_min long, run_size long, head boolean, part int, side int, text binary"))
    # At most two runs of each range, grouped by their whole texts.
    ends = runs.where("head and side is not null").groupBy("sha", "text").agg(
        F.sum("run_size").alias("total"),
        F.min_by(F.struct("run_min", "part", "side"), F.struct(F.col("run_min").isNull(), "run_min", "part", "side")).alias("first"),
        F.collect_list(F.struct("part", "side")).alias("runs"),
    )
    totals = ends.where("size(runs) > 1").select(F.explode("runs").alias("run"), "total", "first").select("run.part", "run.side", "total", "first")
    joined = runs.drop("text").join(F.broadcast(totals), ["part", "side"], "left")
    return joined.select(
        "id",
        F.when(F.col("total").isNull(), F.col("run_min")).otherwise(F.col("first.run_min")).alias("keep_id"),
        F.coalesce("total", "run_size").alias("group_size"),
        (F.col("head") & (F.col("total").isNull() | ((F.col("first.part") == F.col("part")) & (F.col("first.side") == F.col("side"))))).alias("kept"),
        "sha",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its columns: a row with the smallest id of the group, null ids last."""
    found = exact_dedup(docs, id_col, text_col).where("group_size > 1").groupBy(F.col("id").alias("gone"), F.col("sha").alias("mark"))
    # Of the rows that share id and text one is kept at most.
    marks = common.materialize(found.agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").drop("n"))
    return bloom.without_rows(docs, id_col, marks, lambda rows, name: rows.withColumn(name, _sha(normalised(F.col(text_col)))))
