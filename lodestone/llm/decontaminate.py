"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Every window of
`size` consecutive words of a benchmark item is a key of the set; an item of fewer words, but not none, is one window.
Training texts are scanned in token windows: a word that no item has breaks a window at once, the others are found by
rolling hash in the sorted keys, and each hit is verified word for word.

The set is broadcast in blocks of about BLOCK_WORDS benchmark words (one item more at most). The driver reads a larger
benchmark block after block and holds one at a time; each scan adds its block's hits to the saved rows of the one
before, so that any size gives whole results. Python workers keep the index of the last block between tasks.

Defined results: null and empty texts have no words and no hits; benchmark rows with null id or text are left out;
items that share an id count once; repeated documents are judged row by row; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

BLOCK_WORDS = 500_000
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Windows:
    """The windows of benchmark items: by length, sorted hashes; by hash, the words and the items."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.rolling = common.Rolling()
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            if w:
                n = min(size, len(w))
                for i in range(len(w) - n + 1):
                    found[n][tuple(w[i : i + n])].add(item)
        self.by_length = {}
        for n, windows in found.items():
            index = defaultdict(list)
            matrix = np.array(list(windows), np.uint64)
            for h, (w, who) in zip(self._hash(matrix), windows.items(), strict=True):
                index[int(h)].append((np.array(w, np.uint64), who))
            self.by_length[n] = (np.sort(np.fromiter(index, np.uint64, len(index))), dict(index))

    def _hash(self, matrix: np.ndarray) -> list[int]:
        return [int(self.rolling.windows(self.rolling.prefix(common.mix(row)), len(row))[0]) for row in matrix]

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words and the items whose windows occur."""
        ids = np.fromiter((self.ids.get(x, 0) for x in w), np.uint64, len(w))
        spans, items = [], set()
        if not ids.any():
            return spans, items
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        prefix = self.rolling.prefix(common.mix(ids))
        for n, (keys, index) in self.by_length.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(full):
                continue
            h = self.rolling.runs(prefix, full, full + n)
            at = np.searchsorted(keys, h)
            for i, value in zip(full[keys[np.minimum(at, len(keys) - 1)] == h], h[keys[np.minimum(at, len(keys) - 1)] == h], strict=True):
                for want, who in index[int(value)]:
                    if np.array_equal(want, ids[i : i + n]):
                        spans.append((int(i), int(i) + n))
                        items |= who
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    held, n = [], 0
    for row in benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        n += len(words(row[1]))
        if n >= BLOCK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


_INDEX: dict[str, Windows] = {}


def _index(key: str, block, size: int) -> Windows:
    """The windows of a block, made once by each worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Windows(block.value, size)
    return _INDEX[key]


def _scanned(rows: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, scan: Callable[[Callable[[], Windows], bool], Callable], size: int) -> DataFrame:
    """rows after a scan by each block; scan(index, last) gives the mapInArrow function of a block."""
    sc, saved = rows.sparkSession.sparkContext, None

    def scanner(block: list[tuple[str, str]], last: bool):
        key, held = uuid.uuid4().hex, sc.broadcast(block)
        return held, scan(lambda: _index(key, held, size), last)

    blocks = _blocks(benchmark, id_col, text_col)
    block = next(blocks, [])
    for after in blocks:
        held, step = scanner(block, False)
        rows = common.materialize(rows.mapInArrow(step, rows.schema))
        held.unpersist()
        if saved is not None:
            common.release(saved)
        saved, block = rows, after
    return rows.mapInArrow(scanner(block, True)[1], rows.schema)


_SCHEMA = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans of hit words, the items found (sorted as strings), and with keep_text the text."""

    def scan(index: Callable[[], Windows], last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = index()

            def row(id_, text, _, spans, items):
                w = words(text)
                new, who = windows.hits(w)
                both = merged([(s["a"], s["b"]) for s in spans] + new)
                return id_, None if last and not keep_text else text, len(w), [{"a": a, "b": b} for a, b in both], sorted(who.union(items))

            return common.row_batches((row(*r) for r in common.rows_of(batches, *_SCHEMA.names)), _SCHEMA, 500)

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), _no_spans().alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    out = _scanned(rows, benchmark, item_col, item_text_col, scan, size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("id", *(["text"] if keep_text else []), "n_words", n_hit.alias("n_hit"), "spans", "items")


def _no_spans():
    return F.expr("cast(array() as array<struct<a:int,b:int>>)")


def contaminated():
    """The contract's rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text less the hit words: from the first byte of each span's first word to the last of its last word."""
    if not text or not spans:
        return text
    raw = text.encode()
    flat, starts, ends, inside = raw.translate(_TABLE), [], [], False
    for i, c in enumerate(flat):
        if (c != 0x20) != inside:
            inside = not inside
            (starts if inside else ends).append(i)
    if inside:
        ends.append(len(raw))
    out, at = [], 0
    for a, b in merged(spans):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """The counts, the SHA-256 of the item ids and the verdict."""
    return found.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their columns: each row is judged by its own hits, whatever its id and
    however many blocks the benchmark has."""
    spans = bloom.unused(docs, "spans")

    def scan(index: Callable[[], Windows], last: bool):
        """Adds a block's hits to the spans; with the last block, the rows that pass are left."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = index()

            def hit(text: str | None, old: list[dict]) -> tuple[int, list[tuple[int, int]]]:
                w = words(text)
                return len(w), merged([(s["a"], s["b"]) for s in old] + windows.hits(w)[0])

            for batch in batches:
                text, at = (batch.schema.get_field_index(c) for c in (text_col, spans))
                for k in range(0, batch.num_rows, 512):
                    piece = batch.slice(k, 512)
                    found = [hit(*r) for r in zip(piece.column(text).to_pylist(), piece.column(at).to_pylist(), strict=True)]
                    if last:
                        hits = [(n, sum(b - a for a, b in s)) for n, s in found]
                        yield piece.filter(pa.array([not (n_hit > 0 and 20 * n_hit >= n) for n, n_hit in hits], pa.bool_()))
                    else:
                        yield piece.set_column(at, spans, pa.array([[{"a": a, "b": b} for a, b in s] for _, s in found], _SCHEMA.field("spans").type))

        return run

    return _scanned(docs.withColumn(spans, _no_spans()), benchmark, item_col, item_text_col, scan, size).drop(spans)


def items_sha256(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
