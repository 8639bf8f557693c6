"""Token ids as patched frame-of-reference blocks.

The ids of a document are cut into blocks of 128. A block stores its least id, the differences to it
at the width that the 90th percentile of them needs, and, for each larger difference, its place and
its high bits. Block starts are listed, so any block can be read without those before it.

Layout of a block, little-endian: u32 least id, u8 width, u8 number of exceptions, the low bits of
all differences (difference i at bits i * width), u8 places of the exceptions, u32 high bits.

Null and empty texts give no block and an empty payload. Each row is encoded by itself, so nulls in
other columns and repeated ids do no harm; texts of any length are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import U64, chunks
from sparkloom.llm.common import texts
from sparkloom.llm.tokens import VOCABULARY, flat_tokens

BLOCK, PERCENTILE, HEAD = 128, 90, 6


def _put(out: np.ndarray, start: np.ndarray, value: np.ndarray, size: int) -> None:
    """Little-endian values of ``size`` bytes at the starts."""
    raw = np.ascontiguousarray(value.astype("<u4")).view(np.uint8).reshape(-1, 4)
    for k in range(size):
        out[start + k] = raw[:, k]


def encode(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Payload bytes of all documents, their n + 1 offsets, block starts within the document, and their n + 1 offsets."""
    count = np.diff(offsets)
    blocks = -(-count // BLOCK)
    doc = np.repeat(np.arange(len(count)), blocks)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = offsets[doc] + within * BLOCK
    size = np.minimum(BLOCK, offsets[doc + 1] - first)
    at = first[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    value = ids[np.where(real, at, first[:, None])] if len(doc) else np.zeros((0, BLOCK), np.uint32)
    least = value.min(axis=1, initial=0xFFFFFFFF)
    delta = value - least[:, None]
    delta[~real] = 0
    # a block's padding holds zeros, which sort first
    rank = BLOCK - size + -(-size * PERCENTILE // 100) - 1
    high = np.take_along_axis(np.sort(delta, axis=1), rank[:, None], axis=1)[:, 0] if len(doc) else np.zeros(0, np.uint32)
    width = np.frexp(high.astype(np.float64))[1].astype(np.int64)
    bytes_packed = -(-size * width // 8)
    over = delta >> width[:, None].astype(np.uint32) if len(doc) else delta
    over[width >= 32] = 0
    block, place = np.nonzero(over)
    exceptions = np.bincount(block, minlength=len(doc))
    length = HEAD + bytes_packed + 5 * exceptions
    ends = np.cumsum(length)
    start = ends - length
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    _put(out, start, least, 4)
    out[start + 4] = width
    out[start + 5] = exceptions
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        low = np.ascontiguousarray((delta[which] & np.uint32((1 << int(w)) - 1)).T).astype(U64)
        words = np.zeros((-(-BLOCK * int(w) // 64) + 1, len(which)), U64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            words[word] |= low[i] << U64(shift)
            if shift + w > 64:
                words[word + 1] |= low[i] >> U64(64 - shift)
        raw = np.ascontiguousarray(words.T).view(np.uint8)
        most = int(bytes_packed[which].max())
        inside = np.arange(most) < bytes_packed[which][:, None]
        out[(start[which][:, None] + HEAD + np.arange(most))[inside]] = raw[:, :most][inside]
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = start[block] + HEAD + bytes_packed[block]
    out[base + nth] = place
    _put(out, base + exceptions[block] + 4 * nth, over[block, place], 4)
    block_offsets = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    payload_offsets = np.concatenate([[0], ends])[block_offsets].astype(np.int64)
    return out, payload_offsets, start - payload_offsets[doc], block_offsets


def decode_block(payload: bytes, start: int, size: int) -> np.ndarray:
    """The ``size`` ids of the block at ``start``."""
    least = int.from_bytes(payload[start : start + 4], "little")
    width, exceptions = payload[start + 4], payload[start + 5]
    at = start + HEAD
    packed = -(-size * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, packed, at), bitorder="little")[: size * width].reshape(size, width)
    delta = (bits.astype(U64) << np.arange(width, dtype=U64)).sum(axis=1, dtype=U64)
    at += packed
    place = np.frombuffer(payload, np.uint8, exceptions, at)
    delta[place] |= np.frombuffer(payload, "<u4", exceptions, at + exceptions).astype(U64) << U64(width)
    return (delta + U64(least)).astype(np.uint32)


def decode(payload: bytes, n_tokens: int, starts) -> np.ndarray:
    parts = [decode_block(payload, s, min(BLOCK, n_tokens - i * BLOCK)) for i, s in enumerate(starts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, block_starts, payload: a row for each row of docs."""

    def run(batches):
        for chunk in chunks(batches):
            ids, offsets = flat_tokens(chunk.column("text"), vocabulary)
            data, ends, starts, blocks = encode(ids, offsets)
            payload = pa.Array.from_buffers(pa.binary(), chunk.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            index = pa.ListArray.from_arrays(pa.array(blocks.astype(np.int32)), pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.diff(offsets)), index, payload], names=["doc_id", "n_tokens", "block_starts", "payload"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, block_starts array<int>, payload binary")
