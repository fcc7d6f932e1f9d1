"""Vectorised word handling shared by the text operators.

A chunk of documents is held as one UTF-8 byte array plus document offsets, as
Arrow stores it. Words are the maximal runs of bytes outside ``\\x20`` and
``\\x09-\\x0D``; no UTF-8 continuation byte lies in that range, so words are
found on bytes without decoding. Word hashes chain a mixer over eight bytes at a
time, on whole arrays; words beyond ``LONG_WORD`` bytes are hashed by keyed
BLAKE2. No structure of a word's bytes carries over to its hash. What must be
told apart for certain is told apart by its bytes (``distinct_spans``).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

# freed Arrow buffers go back to the system, as a worker shares its executor's memory
pa.set_memory_pool(pa.system_memory_pool())
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
    _LIBC.mallopt(-3, 9 << 19)  # arrays beyond a chunk's are mapped, and so go back when they are freed
except (OSError, AttributeError):  # another C library
    _LIBC = None

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1 << 19

#: Words up to this length are hashed on arrays.
LONG_WORD = 64
_KEY = b"gridspan words"


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer for 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x *= _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


@dataclass
class Words:
    """Words of a chunk: byte spans, the document of each and where each document's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1 offsets into starts/ends
    doc_offsets: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def _eights(self) -> np.ndarray:
        """Eight bytes from every place on, as numbers."""
        padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
        padded[: len(self.data)] = self.data
        return np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))

    def equal(self, at: np.ndarray, other: Words, to: np.ndarray) -> np.ndarray:
        """Whether the bytes of words ``at`` are those of the words ``to`` of ``other``."""
        size = self.ends[at] - self.starts[at]
        same = size == other.ends[to] - other.starts[to]
        a, b, live, k = self._eights(), other._eights(), np.flatnonzero(same & (size > 0)), 0
        while len(live):
            left = size[live] - k
            x = a[self.starts[at[live]] + k] ^ b[other.starts[to[live]] + k]
            short = left < 8
            x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            same[live[x != 0]] = False
            live = live[(x == 0) & (left > 8)]
            k += 8
        return same

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.ends - self.starts
        eight = self._eights()
        h = mix(size.astype(np.uint64) * np.uint64(_BASE))
        live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        at = 0
        while len(live):
            left = size[live] - at
            lane = eight[self.starts[live] + at]
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[live] = mix((h[live] ^ lane) + np.uint64(_BASE))
            at += 8
            live = live[left > 8]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self.word(k), digest_size=8, key=_KEY).digest(), "little")
        return h

    def array(self) -> pa.Array:
        """The words themselves."""
        return binary_array(self.data[~_SPACE[self.data]], np.concatenate([[0], np.cumsum(self.ends - self.starts)]))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings ``data[offsets[i]:offsets[i + 1]]``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def binary_buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of byte strings."""
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(strings) + 1 + strings.offset)[strings.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``; a word never spans documents."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, s, e, np.searchsorted(s, offsets), offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every ``k`` consecutive word hashes; the last ``k - 1`` places are cut."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    base = np.uint64(_BASE)
    for j in range(k):
        out *= base
        out += h[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word indices at which ``k`` words of one document begin."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - first[:-1], count)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``most`` whole documents of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    trim()


def distinct_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, first places) of the pieces between consecutive bounds, as ``distinct`` has them but told apart by their bytes."""
    codes = binary_array(data[bounds[0] :] if len(bounds) else data, bounds - bounds[0]).dictionary_encode().indices.to_numpy()
    return codes, _first(codes, int(codes.max(initial=-1)) + 1)


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    first = np.empty(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each hash, place where each code first occurs)."""
    codes, uniques = pd.factorize(h)
    return codes, _first(codes, len(uniques))


def segments(values: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs of ``codes``: run c is ``counts[c]`` values long in ``values``. Also each run's length."""
    start = np.cumsum(counts) - counts
    n = counts[codes]
    total = int(n.sum())
    at = np.arange(total) + np.repeat(start[codes] - (np.cumsum(n) - n), n)
    return values[at], n


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over each ``first[i]:first[i + 1]``."""
    total = np.concatenate([np.zeros(1, dtype=x.dtype), np.cumsum(x)])
    return total[first[1:]] - total[first[:-1]]


class Remembered(dict):
    """A bounded memo of two generations: what is used again stays, what was seen once goes. Only time depends on it."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def get(self, key, default=None):
        found = dict.get(self, key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                return default
            self[key] = found
        return found

    def turn(self) -> None:
        """Between slices: the full generation becomes the old one."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[data]


def trim() -> None:
    """Give freed memory back to the system at the end of a task's work: its worker idles on while others run."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
