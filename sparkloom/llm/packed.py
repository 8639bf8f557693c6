"""Packed shuffles: fixed-width records travel as one binary row for each part, not as a row each.

Map side, ``Packer`` gathers records and cuts them into parts by key; Spark then moves
(part, payload) rows with ``groupBy("part").applyInArrow``, and ``records`` reads a group back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "part int, payload binary"
#: Bytes of records that a map task holds before it passes them on.
HELD = 16 << 20


class Packer:
    def __init__(self, parts: int, once: str | None = None):
        """once: a field; records with equal key and field are passed on once for each batch, so that what a
        whole corpus repeats grows with the number of batches and not with that of its occurrences."""
        self.parts, self.once, self.held, self.size = parts, once, [], 0

    def add(self, records: np.ndarray):
        """records: structured, with an evenly spread u64 field ``key``. Yields full batches."""
        self.held.append(records)
        self.size += records.nbytes
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        records = np.concatenate(self.held)
        self.held, self.size = [], 0
        if self.once:
            records = records[np.lexsort((records[self.once], records["key"]))]
            new = np.ones(len(records), bool)
            new[1:] = (records["key"][1:] != records["key"][:-1]) | (records[self.once][1:] != records[self.once][:-1])
            records = records[new]
        part = ((records["key"] >> np.uint64(20)) % np.uint64(self.parts)).astype(np.uint16 if self.parts < 1 << 16 else np.uint32)
        records = records[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=self.parts)
        which = np.flatnonzero(count)
        offsets = np.concatenate([[0], np.cumsum(count[which] * records.itemsize)]).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), payload], names=["part", "payload"])


def records(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column("payload")), dtype=dtype)
