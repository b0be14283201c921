"""Helpers shared by the corpus operators: word hashing, rolling hashes, Arrow iteration, shared storage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release  # noqa: F401

U64 = np.uint64
#: Odd multipliers of the polynomial and of the finaliser (fixed values).
POLY = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
#: Words that a worker remembers something of before its memory is emptied.
WORD_MEMORY = 300_000


def input_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a string column, counted over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def block_count(total: int, each: int, least: int = 1) -> int:
    """How many blocks of about `each` bytes hold `total` bytes."""
    return max(least, math.ceil(total / each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> U64(30))) * U64(MIX_A)
    x = (x ^ (x >> U64(27))) * U64(MIX_B)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of word runs by prefix sums of a polynomial modulo 2^64."""

    INVERSE = pow(POLY, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n + 1:
            m = max(n + 1, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m, POLY, U64))])
            self.down = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m, self.INVERSE, U64))])

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes))
        return np.concatenate([np.zeros(1, U64), np.cumsum(hashes * self.up[: len(hashes)])])

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of words starts[i] .. ends[i]-1, whatever their place in the document."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(MIX_A))

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((prefix[size:] - prefix[:n]) * self.down[:n] + U64(size * MIX_A & MASK))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = Rolling()
#: Texts beyond this many bytes are hashed word by word, so that no array of powers grows with them.
WHOLE = 4 << 20


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text (split at ASCII white space), and the number that its last two bytes make."""
    if len(raw) > WHOLE:
        parts, at = [], 0
        while at < len(raw):
            end = at + WHOLE // 2
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            piece = raw[at:end]
            parts.append(hashed_words(piece) if len(piece) <= WHOLE else ([_long_word(w) for w in piece.split()], [int.from_bytes(w[-2:], "little") for w in piece.split()]))
            at = end
        return np.concatenate([np.array(h, U64) for h, _ in parts]), np.concatenate([np.array(t, np.int32) for _, t in parts])
    letters = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[letters], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    h = _BYTES.runs(_BYTES.prefix(letters.astype(U64) + U64(1)), starts, ends)
    last = letters[ends - 1].astype(np.int32)
    tail = np.where(ends - starts > 1, letters[np.maximum(ends - 2, 0)] + 256 * last, last) if len(ends) else last
    return h, tail


def _long_word(word: bytes) -> int:
    """The same hash for a word of any length."""
    total, power = 0, 1
    if len(word) > WHOLE:
        return xxhash.xxh3_64_intdigest(word)
    for c in word:
        total = (total + (c + 1) * power) & MASK
        power = power * POLY & MASK
    return int(mix(np.array([(total + len(word) * MIX_A) & MASK], U64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a small piece at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            yield from zip(*(piece.column(c).to_pylist() for c in columns), strict=True)


class Sink:
    """Collects rows (lists or numpy arrays by column) and gives Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 50_000) -> None:
        self.schema, self.limit = schema, rows
        self.parts: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, n: int, *columns) -> None:
        for part, column, field in zip(self.parts, columns, self.schema, strict=True):
            part.append(column if isinstance(column, pa.Array) else pa.array(column, field.type))
        self.held += n

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.held >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in self.parts], schema=self.schema)
            self.parts, self.held = [[] for _ in self.schema], 0


def row_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def kept_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows, with all their columns, whose text passes: no shuffle, no join. keep() is called once in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                yield piece.filter(pa.array([passes(t) for t in piece.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def per_row(fn: Callable[..., tuple], columns: tuple[str, ...], schema: pa.Schema, size: int = 2_000):
    """A mapInArrow function that gives one row for each row read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches((fn(*row) for row in rows_of(batches, *columns)), schema, size)

    return run
