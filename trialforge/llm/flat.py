"""Flat numpy views of Arrow text columns.

Python operators work on whole Arrow batches: all texts of a slice become one
byte array with offsets, words are found with a lookup table, and equal words
share a dictionary code.  Slices are bounded in bytes, so the working set does
not grow with the table; one text larger than the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; operators take some 40 times as much for a slice.
SLICE_BYTES = 1 << 20

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = x ^ (x >> _R)
    x = x * M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> _R
    return x


@dataclass
class Words:
    """Words of the texts of one slice."""

    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: byte offsets of the texts
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    docs: np.ndarray  #: word offsets of the texts
    codes: np.ndarray  #: dictionary code of each word
    distinct: pa.Array  #: the dictionary

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.distinct.to_pylist()), dtype=np.uint64, count=len(self.distinct))
        return own[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back: workers are reused, and what one stage freed would count in the next."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large-binary array over given bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(texts: pa.Array, lower: bool = False, spaces: np.ndarray = SPACE) -> Words:
    """Words of every text, never across texts; ``lower`` maps A-Z only."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    apart = spaces[data]
    n = len(data)
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = apart[:-1], apart[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = True, True
    inside = ~apart
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = binary_array(data[inside], at).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), codes, coded.dictionary)


def gather(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the elements of the picked lists one after another, and the lists' new offsets."""
    sizes = np.diff(offsets)[picks] if len(picks) else np.zeros(0, np.int64)
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.repeat(offsets[:-1][picks] - out[:-1], sizes) + np.arange(out[-1]), out


def spans(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """lows[0], lows[0] + 1, ... for each span of the given size."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(lows - at[:-1], sizes) + np.arange(at[-1])


def list_array(values: pa.Array | np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
