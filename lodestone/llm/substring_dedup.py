"""Substring deduplication by relative Lempel-Ziv parsing over words.

Every document is a reference for the documents with larger ids. Reference text is indexed in blocks cut by content: a
window of `size` words belongs to the anchor that is the smallest hash of its ANCHOR-word runs, and consecutive windows
with one anchor form a block. Equal windows have equal anchors wherever they stand, so a document need only be parsed
against the blocks under its own anchors, and no reference block that could match is missed.

The parse is greedy. The index has each reference block and each of its windows with the smallest id that has it. Where
all documents with an anchor have the same block, the document copies the whole block at once from the smallest of them.
Elsewhere a factor may end within the block (something before or after differs), and each of its windows is checked on
its own in the index. From left to right, a factor goes on as long as the windows are copied from one document, and so
has `size` words at least; the words of all factors are the duplicate spans, and each factor names its source.

Blocks and windows are compared by 128 bits of hash (the anchor's 64 and 64 of the content), not word for word: the
words of a reference are never sent to the documents that copy from it. All exchange is by key with partial aggregation
or by joins whose hot keys Spark can split; there is no list of a key's documents anywhere, and what is gathered for a
row is of its own text (rows with equal ids and texts share it).

Defined results: words are split at ASCII white space and unchanged; null or empty texts have none; rows that share an
id are never each other's references, and rows without an id are references of nothing and copy from any; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

ANCHOR = 16
#: Stands for "no id": larger than all ids.
NO_ID = (1 << 63) - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


#: Hashes of what is copied, and the documents it is copied from.
Copies = tuple[np.ndarray, np.ndarray]


class Parser:
    """Anchors, blocks and windows of documents."""

    def __init__(self, size: int) -> None:
        if size <= ANCHOR:
            raise ValueError(f"size must be over {ANCHOR}")
        self.size, self.rolling = size, common.Rolling()

    def anchors(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window and the prefix sums of the word hashes."""
        words, _ = common.hashed_words(raw)
        if len(words) < self.size:
            return np.zeros(0, np.uint64), self.rolling.prefix(words)
        prefix = self.rolling.prefix(words)
        return sliding_min(self.rolling.windows(prefix, ANCHOR), self.size - ANCHOR + 1), prefix

    def blocks(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The anchor and the content's hash of each block."""
        anchor, prefix = self.anchors(raw)
        if not len(anchor):
            return anchor, anchor
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(first[1:], len(anchor)) - 1 + self.size
        return anchor[first], self.rolling.runs(prefix, first, end)

    def windows(self, raw: bytes, open_anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor and the hash of each window whose anchor is among open_anchors."""
        anchor, prefix = self.anchors(raw)
        at = np.flatnonzero(np.isin(anchor, open_anchors))
        return anchor[at], self.rolling.runs(prefix, at, at + self.size)

    def sources(self, raw: bytes, whole: Copies, single: Copies) -> np.ndarray:
        """Which document each window is copied from, by its anchor in `whole` or its hash in `single`; -1 for none."""
        anchor, prefix = self.anchors(raw)
        found = _looked_up(anchor, whole)
        if len(single[0]) and len(found):
            at = np.flatnonzero(found < 0)
            found[at] = _looked_up(self.rolling.runs(prefix, at, at + self.size), single)
        return found


def _looked_up(keys: np.ndarray, table: Copies) -> np.ndarray:
    if not len(table[0]) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    known = table[0].view(np.uint64)
    order = np.argsort(known)
    known, values = known[order], table[1][order]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], -1)


def factors_of(sources: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(first word, word after the last, source) of the factors: each goes on as long as its windows have one source."""
    edge = np.flatnonzero(np.concatenate([[True], sources[1:] != sources[:-1]])) if len(sources) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(sources))
    return [(int(a), int(b) - 1 + size, int(sources[a])) for a, b in zip(edge, ends, strict=True) if sources[a] >= 0]


def covered_by(factors: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of n words lies in a factor."""
    depth = np.zeros(n + 1, np.int64)
    for a, b, _ in factors:
        depth[a] += 1
        depth[b] -= 1
    return np.cumsum(depth[:-1]) > 0


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _keys(x) -> np.ndarray:
    return np.array(x or (), np.int64).view(np.uint64)


def _copies(column: pa.ListArray, key: str) -> Iterator[Copies]:
    """Each row's structs as two arrays."""
    ends, values = column.offsets.to_numpy(), column.values
    keys, sources = (values.field(f).to_numpy(zero_copy_only=False) for f in (key, "source"))
    yield from ((keys[a:b], sources[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))


def _emit(size: int, names: tuple[str, ...], fn):
    """A mapInArrow function: fn(parser, raw text, *columns) gives two hash arrays; rows are (id, row, first, second)."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out = Parser(size), common.Sink(schema, 200_000)
        for id_, row, text, *rest in common.rows_of(batches, "id", "row", "text", *names):
            if text and len(text) >= 2 * size - 1:
                a, b = fn(parser, text.encode(), *rest)
                if len(a):
                    out.add(len(a), np.full(len(a), id_, np.int64), np.full(len(a), row, np.int64), common.signed(a), common.signed(b))
                    yield from out.full()
        yield from out.rest()

    return run


_ROWS = "id long, row long, anchor long, content long"


def parsed(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each input row (id, text) with what it copies and from whom: `whole`, anchors whose blocks are copied entirely, and
    `single`, hashes of further copied windows."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    base = docs.select(key.alias("id"), F.col(text_col).alias("text")).select("id", F.xxhash64("id", "text").alias("row"), "text")
    blocks = common.materialize(base.mapInArrow(_emit(size, (), lambda p, w: p.blocks(w)), _ROWS))
    anchors = blocks.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min("id").alias("first"), F.max("id").alias("last"))
    shared = anchors.where("first < last").select("anchor", (F.col("lo") == F.col("hi")).alias("same"), "first")
    touched = blocks.select("id", "row", "anchor").join(shared, "anchor").where("not same or id > first")
    copies = F.collect_set(F.when(F.col("same"), F.struct("anchor", F.col("first").alias("source"))))
    routed = common.materialize(touched.groupBy("row").agg(copies.alias("whole"), F.collect_set(F.when(~F.col("same"), F.col("anchor"))).alias("open")))
    common.release(blocks)
    open_ = routed.where("size(open) > 0").select("row", "open")
    near = bloom.marked(base, F.col("row"), open_, F.col("row"), "maybe").where("maybe").drop("maybe").join(open_, "row")
    windows = common.materialize(near.mapInArrow(_emit(size, ("open",), lambda p, w, o: p.windows(w, _keys(o))), _ROWS))
    index = windows.groupBy("anchor", "content").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").select("anchor", "content", "source")
    copied = common.materialize(windows.join(index, ["anchor", "content"]).where("id > source").groupBy("row").agg(F.collect_set(F.struct("content", "source")).alias("single")))
    common.release(windows)
    # Only rows that may copy something are sent to what they copy.
    flagged = bloom.marked(base, F.col("row"), routed, F.col("row"), "maybe")
    alone = flagged.where("not maybe").drop("maybe").select("id", "text", *[F.lit(None).cast(t).alias(n) for n, t in (("whole", "array<struct<anchor:long,source:long>>"), ("single", "array<struct<content:long,source:long>>"))])
    with_copies = flagged.where("maybe").drop("maybe").join(routed.select("row", "whole"), "row", "left").join(copied, "row", "left")
    return with_copies.select("id", "text", "whole", "single").unionByName(alone)


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def duplicate_spans(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, factors (word positions and the id copied from), spans (of words that
    factors cover), kept_text."""
    place = [("a", pa.int32()), ("b", pa.int32())]
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", pa.list_(pa.struct([*place, ("source", pa.int64())]))), ("spans", pa.list_(pa.struct(place))), ("kept_text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(size)

        def row(id_, text, whole, single):
            id_, words = None if id_ == NO_ID else id_, _words(text)
            if len(words) < size or not len(whole[0]) + len(single[0]):
                return id_, len(words), 0, [], [], b" ".join(words).decode()
            factors = factors_of(parser.sources(text.encode(), whole, single), size)
            covered = covered_by(factors, len(words))
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            return id_, len(words), len(words) - len(kept), [{"a": a, "b": b, "source": s} for a, b, s in factors], [{"a": a, "b": b} for a, b in spans_of(covered)], b" ".join(kept).decode()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    piece = batch.slice(k, 256)
                    copies = (_copies(piece["whole"], "anchor"), _copies(piece["single"], "content"))
                    yield from (row(*r) for r in zip(piece["id"].to_pylist(), piece["text"].to_pylist(), *copies, strict=True))

        return common.row_batches(rows(), schema, 500)

    return parsed(docs, size, id_col, text_col).mapInArrow(run, "id long, n_words long, n_removed long, factors array<struct<a:int,b:int,source:long>>, spans array<struct<a:int,b:int>>, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], size: int = 50) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) by the definition, for tests."""
    first: dict[tuple, int] = {}
    key = [(NO_ID if i is None else i, _words(t)) for i, t in rows]
    for i, w in key:
        for s in range(len(w) - size + 1):
            x = tuple(w[s : s + size])
            first[x] = min(first.get(x, NO_ID), i)
    out = []
    for (i, w), (id_, _) in zip(key, rows, strict=True):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((id_, len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
