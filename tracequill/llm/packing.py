"""Compact rows for shuffling many hashes: sorted byte planes under zstandard.

A payload holds sorted 64-bit keys, a reference (row number into a table of documents and a
position) per key, and that table, so it is complete in itself: a recomputed task may cut its
input into other batches without harm.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_LEVEL = 1


def planes(a: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of each value, one byte plane after the other."""
    raw = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def width_of(a: np.ndarray) -> int:
    return max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers (each of its own length), as few bytes as their largest value needs."""
    head, body = [struct.pack("<B", len(columns))], []
    for a in columns:
        w = width_of(a)
        head.append(struct.pack("<QB", len(a), w))
        body.append(planes(a, w))
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count, at, shapes, out = raw[0], 1, [], []
    for _ in range(count):
        shapes.append(struct.unpack_from("<QB", raw, at))
        at += 9
    for n, w in shapes:
        out.append(unplanes(raw[at : at + n * w], n, w))
        at += n * w
    return out
