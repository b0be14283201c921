"""Supersteps over a table of mail: what large iterative operators exchange by key.

A row of mail has the key it goes to, a kind, a sub-key (mostly the sender), a blob of packed numpy arrays and two
numbers that Spark can sum. A step groups the mail by key and lets one function answer each key's mail with new mail;
what a key must remember it mails to itself. Blobs are packed in few bytes, so that a step moves little more than the
numbers it needs, and a key's mail is bounded by how many keys the caller makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = pa.schema([("key", pa.int32()), ("kind", pa.string()), ("sub", pa.int32()), ("blob", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
DDL = "key int, kind string, sub int, blob binary, a long, b long"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes. Hashes (uint64) stay as they are; counts (int64, none negative) take the narrowest type."""
    heads, bodies = [np.array([len(arrays)], np.int64).tobytes()], []
    for x in arrays:
        if x.dtype != np.uint64:
            most = int(x.max()) if len(x) else 0
            x = x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)
        heads.append(f"{x.dtype.str:<4}".encode() + np.array([len(x)], np.int64).tobytes())
        bodies.append(x.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(heads + bodies))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays: hashes as uint64, counts as int64."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    at, found = 8 + 12 * count, []
    for k in range(count):
        kind = np.dtype(raw[8 + 12 * k : 12 + 12 * k].decode().strip())
        size = int(np.frombuffer(raw, np.int64, 1, 12 + 12 * k)[0])
        x = np.frombuffer(raw, kind, size, at)
        at += size * kind.itemsize
        found.append(x if kind == np.uint64 else x.astype(np.int64))
    return found


class Letter:
    """One row of mail, its blob still packed."""

    __slots__ = ("kind", "sub", "blob")

    def __init__(self, kind: str, sub: int, blob: bytes) -> None:
        self.kind, self.sub, self.blob = kind, sub, blob

    def arrays(self) -> list[np.ndarray]:
        return unpack(self.blob)


def letter(key: int, kind: str, sub: int, blob: bytes = b"", a: int = 0, b: int = 0) -> tuple:
    return key, kind, sub, blob, a, b


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > 4 << 20 or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def step(mail: DataFrame, answer: Callable[[int, list[Letter]], Iterator[tuple]]) -> DataFrame:
    """Mail of the next step: what answer(key, letters) gives. Letters come in the order of kind and sub."""

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(answer(key[0].as_py(), letters(parts)))

    return mail.where("key >= 0").groupBy("key").applyInArrow(run, DDL)


def letters(parts: Iterator[pa.RecordBatch]) -> list[Letter]:
    found = [Letter(*row) for b in parts for row in zip(*(b.column(c).to_pylist() for c in ("kind", "sub", "blob")), strict=True)]
    return sorted(found, key=lambda x: (x.kind, x.sub))
