"""Vectorised text primitives shared by the operators: chunks, code points, words, hashes."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled by one round of numpy work; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
BASE = U64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``text`` each, and at most ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(size + 16)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give memory that a task no longer uses back to the system: a worker waits for its next task beside a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the n + 1 offsets of the rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None else b""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:  # row by row, so that a broken byte stays in its row
        rows = [data[a - offsets[0] : b - offsets[0]].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        text = "".join(rows)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts
    byte = np.frombuffer(data, dtype=np.uint8)
    lead = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), lead[offsets - offsets[0]].astype(np.int64)


@cache
def fold_table() -> np.ndarray:
    """For each code point of the basic plane its lower case, or 0 where it is no letter, mark or digit."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.category(c)[0] in "LNM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def fold(codes: np.ndarray) -> np.ndarray:
    """Case-folded code points with 0 for separators; code points past the basic plane stay as they are."""
    table = fold_table()
    if len(codes) and codes.max() >= 1 << 16:
        return np.where(codes < 1 << 16, table[np.minimum(codes, (1 << 16) - 1)], codes)
    return table[codes]


_POWERS = {BASE: np.ones(1, U64), BASE_INV: np.ones(1, U64)}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept while small."""
    have = _POWERS[base]
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * (have[-1] * base)])
    if len(have) <= 1 << 23:
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P[i] = sum of (codes[j] + 1) * BASE**j for j < i, modulo 2**64."""
    out = np.zeros(len(codes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(U64) + U64(1)) * powers(len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Position-free hash of the spans [start, end); inverse = powers(n, BASE_INV)."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * inverse[start]


class Words:
    """Folded words of a chunk: start and end (in code points of the chunk), hash, and per row the first word."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.folded = fold(codes)
        word = self.folded > 0
        n = len(codes)
        before = np.zeros(n + 1, bool)
        before[1:] = word
        before[starts] = False
        self.start = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(n + 1, bool)
        after[:-1] = word
        after[starts] = False
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, starts)
        size = self.end - self.start
        at = np.cumsum(size) - size
        chars = self.folded[word].astype(U64)
        within = np.arange(len(chars)) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            chars *= powers(int(size.max()) if len(size) else 0)[within]
        self.hash = mix(np.add.reduceat(chars, at)) if len(at) else np.zeros(0, U64)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
