"""Vectorised hashing of the words of many documents at once (runs in tasks).

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, i.e.
``[^\\x20\\x09-\\x0D]+``.  All of these bytes are ASCII, so words can be cut
from UTF-8 bytes directly, and ``bytes.split()`` cuts exactly the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial hashes (2^64 / golden ratio) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Documents are handled in slices of about this many bytes, so that a task's
#: numpy arrays stay small whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser (splitmix64) of 64-bit lanes; wraps silently."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) + U64(1 << 32)) | U64(1)
_tables: dict[str, np.ndarray] = {}


def _table(name: str, n: int) -> np.ndarray:
    """Grown-on-demand per-worker tables: position keys and powers of BASE."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(4096, 1 << int(n).bit_length())
        if name == "pos":
            have = mix(np.arange(size, dtype=U64)) | U64(1)
        else:
            have = np.full(size, BASE if name == "pow" else BASE_INV, dtype=U64)
            have[0] = 1
            have = np.cumprod(have, dtype=U64)
        _tables[name] = have
    return have[:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    if buffers[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole documents of about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        # a document starts a new slice when the bytes before it fill one
        cut = np.concatenate([[0], np.cumsum(size, dtype=np.int64)[:-1]]) // limit
        starts = np.flatnonzero(np.diff(cut, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    release()


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are
    reused, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # another C library
        pass


@dataclass
class Words:
    """Words of a slice of documents, in order."""

    hash: np.ndarray     # 64-bit hash of each word's bytes
    doc: np.ndarray      # row of its document in the slice
    first: np.ndarray    # per document: index of its first word (n + 1 entries)
    start: np.ndarray    # byte offsets in the slice's buffer
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only, byte-wise."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def cut_words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Find and hash every word; words never run across documents."""
    n_docs = len(offs) - 1
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = True
        np.logical_not(solid[:-1], out=before[1:])
        before |= edge[:-1]
    start = np.flatnonzero(solid & before)
    if len(start) == 0:
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), e, np.zeros(n_docs + 1, np.int64), e, e)
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    end = np.flatnonzero(solid & after) + 1
    size = end - start
    at = np.flatnonzero(solid)
    lead = np.concatenate([[0], np.cumsum(size)[:-1]])
    pos = np.arange(len(at)) - np.repeat(lead, size)
    keyed = _BYTE[data[at]] * _table("pos", int(size.max()))[pos]
    h = mix(np.add.reduceat(keyed, lead) ^ mix(size.astype(U64)))
    first = np.searchsorted(start, offs, side="left")
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(h, doc, first, start, end)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Prefix sums for ``run_hash``; one entry more than there are words."""
    out = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * _table("pow", len(words)), dtype=U64, out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of ``size`` consecutive words from each ``start``; depends on the
    words alone, not on where they stand."""
    return mix((prefix[start + size] - prefix[start]) * _table("inv", len(prefix))[start])


def as_long(h: np.ndarray) -> pa.Array:
    """Unsigned lanes as Spark longs (same bits)."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
