"""Arrays of whole numbers as small compressed buffers, for payloads that tasks exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers of at least 0 as one compressed buffer, each array with as few bytes as its largest needs, byte by byte."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        out.append(np.array([len(a), width], dtype="<i8").tobytes() + planes.tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, dtype="<i8", count=2, offset=at).tolist()
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at + 16).reshape(width, n)
        a = planes[0].astype(np.int32 if width < 4 else np.int64)
        for k in range(1, width):
            a |= planes[k].astype(a.dtype) << (8 * k)
        out.append(a)
        at += 16 + n * width
    return out


def delta(a: np.ndarray) -> np.ndarray:
    """Differences with the sign in the lowest bit, which are small for ids in order."""
    d = np.diff(a.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def undelta(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return np.cumsum((a.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(a & 1))
