"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up the rank of every adjacent pair by binary search
over sorted pair keys, takes each word's lowest rank and merges its occurrences from left to right, until no word has
a known pair. A worker remembers the ids of words it has met (WORD_MEMORY words, then it starts anew); texts of any
length are processed whole.

The vocabulary file (JSON of the tokenizers library) is a parameter and is read on the driver; what is broadcast is
its vocabulary, whose size doesn't depend on the data. Added tokens are recognised in texts, as the library does.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The byte-level pre-tokeniser's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Letters up to U+024F. Texts of these, ASCII digits, signs and white space are cut by the faster standard module.
_LATIN = "a-zA-Z" + "".join(chr(c) for c in range(0xAA, 0x250) if chr(c).isalpha())
_FAST = re.compile(rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^{_LATIN}0-9\t-\r -/:-@\[-`{{-~]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Slots(dict):
    """The slot of each word; new words get the next one and wait to be merged."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self.waiting.append(word)
        return slot


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        letters = byte_letters()
        vocab: dict[str, int] = data["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.base = np.array([vocab[c] for c in letters], np.int64)
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in t)
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        self.flat = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.base[raw]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            live = lowest != NONE
            if not live.all():
                done_ids.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
            hit = rank == lowest
            if not len(hit):
                break
            # In a row of overlapping hits every second one merges.
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            symbols[hit] = self.results[lowest[hit]]
            stay = ~np.concatenate([[False], hit[:-1]])
            symbols, word = symbols[stay], word[stay]
        ids, of = (np.concatenate(done_ids), np.concatenate(done_words)) if done_ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def _learn(self) -> None:
        words, self.slots.waiting = self.slots.waiting, []
        if words:
            ids, sizes = self.merge([w.encode() for w in words])
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat, self.starts, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def _cut(self, text: str) -> np.ndarray:
        """Slots of the words of a text."""
        words = (self.pattern if _OTHER.search(text) else _FAST).findall(text)
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.slots) > common.WORD_MEMORY:
            self._forget()
        cut = [[self.added[p] if p in self.added else self._cut(p) for p in (self.split.split(t) if self.split else [t]) if p] for t in texts]
        self._learn()
        return [self._ids(parts) for parts in cut]

    def _ids(self, parts: list) -> np.ndarray:
        out = [self._gather(x) if isinstance(x, np.ndarray) else np.array([x], np.int64) for x in parts]
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int64), *out])

    def _gather(self, slot: np.ndarray) -> np.ndarray:
        size = self.sizes[slot]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[slot] - ends + size, size) + np.arange(ends[-1])]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _groups(rows: Iterator[tuple], chars: int = 2_000_000) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1] or "") + 100
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ids (array<int>)."""
    spec = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        for rows in _groups(common.rows_of(batches, "id", "text")):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([x.astype(np.int32) for x in bpe.encode_batch([r[1] or "" for r in rows])], schema.field("ids").type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """One row per input row (id, ids): id and text; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        return common.row_batches(((i, bpe.decode(x or ())) for i, x in common.rows_of(batches, "id", "ids")), schema)

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256."""
    spec = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(bpe: Bpe, rows: list[tuple]) -> Iterator[tuple]:
        for (id_, _), ids in zip(rows, bpe.encode_batch([r[1] or "" for r in rows]), strict=True):
            yield id_, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        return common.row_batches((d for rows in _groups(common.rows_of(batches, "id", "text")) for d in digests(bpe, rows)), schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
