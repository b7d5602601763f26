"""Cheapest alignment of two sequences within a band, in memory that grows with the root of their product."""

from __future__ import annotations

import numpy as np

#: Cost of a gap, of equal channel and type with another context, and of anything else.
GAP, VALUE, STRUCTURE = 2, 1, 5
_FAR = 1 << 30


class _Band:
    """Rows of costs over the offsets low..high of b's place from a's; row i has used i elements of a."""

    def __init__(self, a, b, kind_a, kind_b, low: int, high: int):
        self.a, self.b, self.kind_a, self.kind_b, self.low, self.high = a, b, kind_a, kind_b, low, high
        self.width = high - low + 1
        self.steps = GAP * np.arange(self.width, dtype=np.int32)
        self.column = np.arange(low, high + 1)

    def first(self) -> np.ndarray:
        return np.where((self.column >= 0) & (self.column <= len(self.b)), GAP * self.column, _FAR).astype(np.int32)

    def next(self, row: np.ndarray, i: int, choice: np.ndarray | None = None) -> np.ndarray:
        """Row i from the one before; choice receives 0 for a pairing, 1 for a deletion, 2 for an insertion."""
        start, zero, end = max(0, 1 - self.low - i), max(0, -self.low - i), min(self.width, len(self.b) - self.low - i + 1)
        diag = np.full(self.width, _FAR, np.int32)
        if end > start:
            at = slice(self.low + i + start - 1, self.low + i + end - 1)
            diag[start:end] = row[start:end] + np.where(self.b[at] == self.a[i - 1], 0, np.where(self.kind_b[at] == self.kind_a[i - 1], VALUE, STRUCTURE))
        up = np.append(row[1:], np.int32(_FAR)) + np.int32(GAP)
        up[:zero] = up[end:] = _FAR
        now = np.minimum.accumulate(np.minimum(diag, up) - self.steps) + self.steps  # a run of insertions from the best place before
        now[:zero] = now[end:] = _FAR
        if choice is not None:
            left = np.append(np.int32(_FAR), now[:-1]) + np.int32(GAP)
            choice[:] = np.where((diag <= up) & (diag <= left), 0, np.where(up <= left, 1, 2))
            choice[:start] = 1  # nothing of b is used yet
        return now


def _costs(a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray) -> np.ndarray:
    return np.where(a == b, 0, np.where(kind_a == kind_b, VALUE, STRUCTURE))


def _straight(a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray, low: int, high: int, width: int) -> bool:
    """Whether to pair each place with its own is cheapest for sure, up to each place: a way that leaves it has an insertion and, at each place, a deletion or its best pairing off it."""
    on = _costs(a, b, kind_a, kind_b)
    if on.sum() >= GAP * 2 * (width + 1) and (low < -width or high > width):
        return False
    off = np.full(len(a), GAP)
    for d in range(1, min(width, len(a) - 1) + 1):
        if d <= high:
            off[:-d] = np.minimum(off[:-d], _costs(a[:-d], b[d:], kind_a[:-d], kind_b[d:]))
        if -d >= low:
            off[d:] = np.minimum(off[d:], _costs(a[d:], b[:-d], kind_a[d:], kind_b[:-d]))
    gain = np.concatenate([[0], np.cumsum(on - off)])
    return bool((gain - np.minimum.accumulate(gain)).max() <= GAP)


def aligned(a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray, low: int, high: int, width: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest alignment of a and b: places in each (-1: none) and costs.

    a, b: fingerprints; kind_a, kind_b: signatures. Offsets stay in low..high, which must hold 0 and
    len(b) - len(a). Of equal costs a pairing goes before a deletion, that before an insertion.

    A narrow band comes first. A way out of it and back has so many gaps that a cheaper result proves the
    band wide enough for every cheapest way; otherwise the cost found says how wide it must be, so there
    are two tries at most. Every r-th row is kept, r about the root of len(a), and the choices of r rows at a
    time are worked out again on the way back: memory is about 4 * root(len(a)) * width bytes.
    """
    n, m = len(a), len(b)
    if n == m and _straight(a, b, kind_a, kind_b, low, high, width):
        return np.arange(n), np.arange(n), _costs(a, b, kind_a, kind_b)
    near, far = min(0, m - n), max(0, m - n)
    stride = max(1, int(2 * n**0.5))
    while True:
        band = _Band(a, b, kind_a, kind_b, max(low, near - width), min(high, far + width))
        row, kept = band.first(), []
        for i in range(1, n + 1):
            if (i - 1) % stride == 0:
                kept.append(row)
            row = band.next(row, i)
        total = int(row[m - n - band.low])
        if (band.low <= low and band.high >= high) or total < GAP * (far - near + 2 * (width + 1)):
            break
        width = max(width + 1, total // (2 * GAP) - (far - near) // 2 + 1)
    pa, pb, i, j = [], [], n, m
    for block in reversed(range(len(kept))):
        base, row = block * stride, kept.pop()
        choice = np.empty((i - base, band.width), np.uint8)
        for k in range(len(choice)):
            row = band.next(row, base + k + 1, choice[k])
        while i > base:
            c = choice[i - base - 1, j - i - band.low]
            i, j = i - (c != 2), j - (c != 1)
            pa.append(-1 if c == 2 else i)
            pb.append(-1 if c == 1 else j)
    pa += [-1] * j
    pb += range(j - 1, -1, -1)
    pa, pb = np.array(pa[::-1], np.int64), np.array(pb[::-1], np.int64)
    both = (pa >= 0) & (pb >= 0)
    cost = np.full(len(pa), GAP, np.int64)
    cost[both] = np.where(a[pa[both]] == b[pb[both]], 0, np.where(kind_a[pa[both]] == kind_b[pb[both]], VALUE, STRUCTURE))
    return pa, pb, cost


def _swept(row: np.ndarray, a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray) -> np.ndarray:
    """Costs over a band after all of a, from those before it; b begins at the band's lower edge and covers it to the end."""
    width, steps = len(row), GAP * np.arange(len(row), dtype=np.int64)
    for r in range(len(a)):
        at = slice(r, r + width)
        now = row + np.where(b[at] == a[r], 0, np.where(kind_b[at] == kind_a[r], VALUE, STRUCTURE))
        now[:-1] = np.minimum(now[:-1], row[1:] + GAP)
        row = np.minimum.accumulate(now - steps) + steps
    return row


def meeting(a: np.ndarray, b: np.ndarray, kind_a: np.ndarray, kind_b: np.ndarray, reach: int) -> int | None:
    """The offset at which every cheapest alignment of the whole passes the middle of a window, None if this cannot be shown.

    a: an even number of a's elements; b: those from `reach` before the first to `reach` behind the last.
    Costs of neighbouring offsets differ by at most a gap, before a place and behind it. So whatever lies
    outside of the window, to be off the offset with most matches saves at most a gap a step where the window
    begins and ends. If, with all of that given, every way off the offset in the middle costs more than to
    stay on it throughout, no cheapest way does it.
    """
    half, width = len(a) // 2, 2 * reach + 1
    equal = [np.count_nonzero(a == b[k : k + len(a)]) for k in range(width)]
    best = int(np.argmax(equal))
    on = slice(best, best + len(a))
    stay = int(np.where(b[on] == a, 0, np.where(kind_b[on] == kind_a, VALUE, STRUCTURE)).sum())
    given = -GAP * np.abs(np.arange(width, dtype=np.int64) - best)
    to = _swept(given, a[:half], b[: half + 2 * reach], kind_a[:half], kind_b[: half + 2 * reach])
    back = _swept(given[::-1].copy(), a[half:][::-1], b[half:][::-1], kind_a[half:][::-1], kind_b[half:][::-1])[::-1]
    off = np.delete(to + back, best)
    return best - reach if len(off) == 0 or off.min() > stay else None
