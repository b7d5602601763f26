"""Substring dedup: fixed-block anchors, rolling probes, extension to maximal exact repeats.

A window is `window` consecutive words of one document. A word goes if some window over it also
starts in a document with a smaller doc_id.

Documents are dealt into batches by a hash of their id and text, so a batch can be put together again
at any time; their texts are shuffled once, and only hashes travel after that, sorted and packed, each
once a batch: a passage in a third of all rows is one entry per batch, not one per row.

1. Index the non-overlapping blocks of half a window (any window holds a whole one) and probe them
   with the rolling hash of every position, by range of hash space. A hash of several batches that is
   somewhere a block goes back to these batches as a hit; what documents of one batch share is found
   in the batch.
2. Hits are extended: the windows over them are candidates. Their hashes meet in the same way, with
   the smallest doc_id of the batch, and go back where another batch has a smaller one.
3. A window is repeated if its hash came back, or a document of the same batch with a smaller id has
   it. Adjacent repeated windows merge into maximal exact repeats (`spans`), which are cut out.

Nulls and ties: a null text has no words; a row with a null doc_id neither covers another nor
is covered; rows that share a doc_id do not cover each other; a text under `window` words stays
whole; input columns named like an added one are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import OWN, groups_of, partitions, slices, tidy, tidy_group, with_fields
from .packing import pack, unpack

#: Bytes of text in a batch, on average: bounds a task's memory.
BATCH_BYTES = 4 << 20
#: Hashes a task that settles a range of hash space gets, on average.
RANGE_HASHES = 4_000_000
#: Hashes of a range that are sorted at a time: bounds what such a task holds beside the hashes themselves.
STEP_HASHES = 250_000
#: Low bits of an anchor's hash that do not travel: it only finds candidates, so 40 bits do.
ANCHOR_SHIFT = np.uint64(24)
ROUTED = f"{OWN}part int, {OWN}batch long, {OWN}payload binary"
FOUND = f"{OWN}batch long, {OWN}payload binary"


class _Batch:
    """Word hashes of the documents of a batch that have an id and at least `window` words."""

    def __init__(self, table: pa.Table, window: int, block: int, second: bool = False):
        buf, off = w.flatten(table.column("text"))
        starts, ends, woff = w.split(buf, off)
        given = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
        self.keep = (np.diff(woff) >= window) & given.is_valid().to_numpy(zero_copy_only=False)
        inside = np.repeat(self.keep, np.diff(woff))
        self.ids = given.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[self.keep]
        starts, ends = starts[inside], ends[inside]
        self.woff = np.concatenate([[0], np.cumsum(np.diff(woff)[self.keep])]).astype(np.int64)
        self.h = w.hash_words(buf, starts, ends)
        self.h2 = w.hash_words(buf, starts, ends, 1) if second else None
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.woff))
        self.window, self.block = window, block

    def anchors(self):
        """Where blocks can start, their short hashes, and whether the place is a multiple of the block."""
        at = w.window_starts(self.woff, self.block)
        return at, w.rolling(self.h, self.block)[at] >> ANCHOR_SHIFT, (at - self.woff[self.doc[at]]) % self.block == 0

    def windows(self, at: np.ndarray, bits: int):
        return w.rolling(self.h, self.window)[at], w.rolling(self.h2, self.window, 1)[at] >> np.uint64(64 - bits)


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their first value and the steps between them."""
    return np.concatenate([keys[:1], np.diff(keys)])


def _shipped(batch: int, keys: np.ndarray, edges: np.ndarray, ranges: int, columns: tuple) -> pa.Table:
    """A packed row per range of hash space; keys are sorted, columns[0] of them steps."""
    cut = slices(edges, ranges)
    used = [i for i in range(ranges) if cut[i] < cut[i + 1]]
    data = [pack(_sorted(keys[cut[i] : cut[i + 1]]), *(c[cut[i] : cut[i + 1]] for c in columns)) for i in used]
    return pa.table({OWN + "part": pa.array(used, pa.int32()), OWN + "batch": pa.array([batch] * len(used), pa.int64()), OWN + "payload": pa.array(data, pa.binary())})


def _probes(window: int, ranges: int):
    block = (window + 1) // 2

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        batch = _Batch(table, window, block)
        _, key, aligned = batch.anchors()
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = groups_of(key)
        aligned = np.logical_or.reduceat(aligned[order], start) if len(start) else aligned
        key = key[start]
        return _shipped(table.column(OWN + "batch")[0].as_py(), key, key << ANCHOR_SHIFT, ranges, (aligned.astype(np.uint64),))

    return run


def _met(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """One range of hash space: what batches share goes back to them.

    exact False (anchors): every hash of several batches that one of them has as a block.
    exact True (windows): a window of a batch whose smallest doc_id is over that of another batch.
    """
    columns, source = [], []
    for batch in batches:
        for name, data in zip(batch.column(OWN + "batch").to_pylist(), batch.column(OWN + "payload").to_pylist(), strict=True):
            cols = unpack(data)
            np.cumsum(cols[0], out=cols[0])
            columns.append(cols if exact else [cols[0], cols[1].astype(bool)])
            source.append(name)
    if not columns:
        return
    back: list[list] = [[] for _ in source]
    for own in _steps(columns):
        which = np.repeat(np.arange(len(own), dtype=np.int32), [len(c[0]) for c in own])
        key, *rest = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((rest[0], key)) if exact else np.argsort(key, kind="stable")
        key, which = key[order], which[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if exact:
            second, ids = rest[0][order], rest[1][order].view(np.int64)
            new[1:] |= second[1:] != second[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        hit = ids > np.repeat(np.minimum.reduceat(ids, start), size) if exact else np.repeat((size > 1) & np.logical_or.reduceat(rest[0][order], start), size)
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        at = at[np.argsort(which[at], kind="stable")]
        first = groups_of(which[at])
        for i, j in zip(first, np.append(first[1:], len(at)), strict=True):
            back[which[at[i]]].append([key[at[i:j]], second[at[i:j]]] if exact else [key[at[i:j]]])
    del columns
    names, out = [], []
    for name, found in zip(source, back, strict=True):
        if found:
            key, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
            names.append(name)
            out.append(pack(_sorted(key), *rest))
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=[OWN + "batch", OWN + "payload"])


def _steps(columns: list[list[np.ndarray]]) -> Iterator[list[list[np.ndarray]]]:
    """Columns, each sorted by the first of its arrays, cut at the same keys into steps of about `STEP_HASHES` in all; none is empty."""
    steps = 1 + sum(len(c[0]) for c in columns) // STEP_HASHES
    low, high = min(int(c[0][0]) for c in columns), max(int(c[0][-1]) for c in columns) + 1
    edges = np.array([low + (high - low) * i // steps for i in range(1, steps)], np.uint64)
    cuts = [[0, *np.searchsorted(c[0], edges).tolist(), len(c[0])] for c in columns]
    for k in range(steps):
        own = [[x[cut[k] : cut[k + 1]] for x in c] for c, cut in zip(columns, cuts, strict=True)]
        if any(len(c[0]) for c in own):
            yield own


def _back(found: pa.Table, columns: int) -> list[np.ndarray]:
    """What came back to a batch from all ranges."""
    got = [unpack(x) for x in found.column(OWN + "payload").to_pylist()]
    for cols in got:
        cols[0] = np.cumsum(cols[0], dtype=np.uint64)
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.uint64)] * columns


def _candidates(window: int, ranges: int, bits: int):
    block = (window + 1) // 2

    @tidy_group
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({OWN + "part": pa.array([], pa.int32()), OWN + "batch": pa.array([], pa.int64()), OWN + "payload": pa.array([], pa.binary())})
        batch = _Batch(docs, window, block, second=True)
        at, key, aligned = batch.anchors()
        order = np.argsort(key, kind="stable")
        start = groups_of(key[order])
        if len(start):
            doc = batch.doc[at[order]]
            size = np.diff(np.append(start, len(order)))
            own = (doc[start] != doc[start + size - 1]) & np.logical_or.reduceat(aligned[order], start)
            hit = np.zeros(len(batch.h) + 1, np.int64)
            hit[at[order[np.repeat(own, size)]]] = 1
            hit[at[np.isin(key, _back(found, 1)[0])]] = 1
            sums = np.concatenate([[0], np.cumsum(hit)])
            at = w.window_starts(batch.woff, window)
            at = at[sums[at + window - block + 1] > sums[at]]
        a, b = batch.windows(at, bits)
        ids = batch.ids[batch.doc[at]]
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        a, b, ids = a[new], b[new], ids[new]
        return _shipped(docs.column(OWN + "batch")[0].as_py(), a, a, ranges, (b, ids.view(np.uint64)))

    return run


def _repeated(batch: _Batch, found: pa.Table, bits: int) -> np.ndarray:
    """Which words of the batch's long documents repeated windows cover."""
    at = w.window_starts(batch.woff, batch.window)
    edge = np.zeros(len(batch.h) + 1, np.int64)
    if len(at):
        a, b = batch.windows(at, bits)
        ids = batch.ids[batch.doc[at]]
        back, back_b = _back(found, 2)
        order = np.lexsort((b, a))
        a, b, ids, at = a[order], b[order], ids[order], at[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(a)))
        over = ids > np.repeat(np.minimum.reduceat(ids, start), size)
        if len(back):
            by = np.lexsort((back_b, back))
            back, back_b = back[by], back_b[by]
            far = np.zeros(len(start), bool)
            ka, kb = a[start], b[start]
            lo, hi = np.searchsorted(back, ka), np.searchsorted(back, ka, "right")
            for step in range(int((hi - lo).max(initial=0))):
                i = np.flatnonzero(lo + step < hi)
                far[i] |= back_b[lo[i] + step] == kb[i]
            over |= np.repeat(far, size)
        at = at[over]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + batch.window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, bits: int, schema: pa.Schema):
    @tidy_group
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        batch = _Batch(docs, window, (window + 1) // 2, second=True)
        gone = _repeated(batch, found, bits)
        at = np.cumsum(batch.keep) - 1
        n_words, n_removed, kept, spans = [], [], [], []
        for row, text in enumerate(docs.column("text").cast(pa.large_binary()).to_pylist()):
            parts = (text or b"").split()
            cut = gone[batch.woff[at[row]] : batch.woff[at[row] + 1]] if batch.keep[row] else gone[:0]
            n_words.append(len(parts))
            if not cut.any():
                n_removed.append(0)
                kept.append(b" ".join(parts))
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            n_removed.append(int(cut.sum()))
            kept.append(b" ".join([x for x, g in zip(parts, cut.tolist(), strict=True) if not g]))
            spans.append(edges.reshape(-1, 2).tolist())
        added = {
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
        }
        return pa.table({f.name: added[f.name] if f.name in added else docs.column(f.name) for f in schema})

    return run


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text and any more columns) with n_words, n_removed, kept_text and spans.

    kept_text has the words that stay, joined by one space; spans the removed runs as pairs of
    word positions (start, end).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = partitions(docs.sparkSession)
    added = (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("spans", "array<array<int>>"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, ranges = max(parts, size // BATCH_BYTES), max(parts, size // (4 * RANGE_HASHES))
    bits = min(64, max(8, 2 * int(size).bit_length() - 44))  # with the first hash's 64: chance meetings stay as rare at any size
    name = OWN + "batch"
    schema = with_fields(docs.schema, *added)
    dealt = docs.drop(*(n for n, _ in added)).withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches))).repartition(parts, name)

    def settled(routed: DataFrame, exact: bool) -> DataFrame:
        return routed.repartitionById(ranges, F.col(OWN + "part")).mapInArrow(tidy(lambda it: _met(it, exact)), FOUND)

    hits = settled(dealt.groupBy(name).applyInArrow(_probes(window, ranges), ROUTED), False)
    covered = settled(dealt.groupBy(name).cogroup(hits.groupBy(name)).applyInArrow(_candidates(window, ranges, bits), ROUTED), True)
    return dealt.groupBy(name).cogroup(covered.groupBy(name)).applyInArrow(_cut(window, bits, to_arrow_schema(schema)), schema)
