"""Vectorised word splitting and hashing over flat UTF-8 buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All hashes are 64-bit
polynomials modulo 2**64, finished by a bijective mixer; two bases give independent values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes and words per hashing block: keeps the tables of powers small and in cache.
BYTE_BLOCK, WORD_BLOCK = 1 << 19, 1 << 17

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _tables.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, BYTE_BLOCK + 1024)
        inverse = pow(base, -1, 1 << 64)
        got = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (base, inverse))
        if size <= 4 * BYTE_BLOCK:  # a giant word must not leave giant tables behind
            _tables[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def flatten(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return (_LOWER[buf] if lower else buf), off - off[0]


def split(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the texts among the words."""
    if len(buf) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    gap = space[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | edge[1:-1]
    last[:-1] &= gap[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One hash per word, of its bytes and length."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BYTE_BLOCK, "right")))
        a, b = starts[i], ends[j - 1]
        p, q = _powers(BASES[which], int(b - a) + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((buf[a:b].astype(U64) + U64(1)) * p[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(U64) * U64(BASES[1 - which]))
        i = j
    return out


def rolling(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of every run of `width` consecutive values: one fewer than `width` less than len(h)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    p, q = _powers(BASES[which], WORD_BLOCK + width + 1)
    for i in range(0, n, WORD_BLOCK):
        m = min(WORD_BLOCK, n - i)
        k = m + width - 1
        sums = np.zeros(k + 1, U64)
        np.cumsum(h[i : i + k] * p[:k], out=sums[1:])
        out[i : i + m] = mix((sums[width:] - sums[: m]) * q[:m])
    return out


def window_starts(woff: np.ndarray, width: int) -> np.ndarray:
    """Positions (among all words) where a run of `width` words stays inside its text."""
    n = int(woff[-1])
    if n < width:
        return np.zeros(0, np.int64)
    ok = np.zeros(n + 1, np.int32)
    inside = np.maximum(np.diff(woff) - width + 1, 0)
    has = inside > 0
    np.add.at(ok, woff[:-1][has], 1)
    np.add.at(ok, woff[:-1][has] + inside[has], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def pieces(batches, limit: int = 4 << 20, text: str = "text"):
    """Record batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(text)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def shingles(h: np.ndarray, woff: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, flat, and the n + 1 offsets.

    A text of fewer than `width` words has one shingle, all its words; one without words has none.
    """
    n = np.diff(woff)
    r = rolling(h, width)
    short = {k: rolling(h, k) for k in range(1, width) if (n == k).any()}
    sets = []
    for a, m in zip(woff[:-1].tolist(), n.tolist(), strict=True):
        if m >= width:
            sets.append(np.unique(r[a : a + m - width + 1]))
        elif m:
            sets.append(mix(short[m][a : a + 1] + U64(m)))
        else:
            sets.append(r[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])
