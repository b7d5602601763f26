"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A MinHash sketch of a short item is a set of its smallest shingle hashes. For containment it is
looked up in the document's own shingles instead of being compared with a sketch of the document,
so a document may be of any length. Items are partitioned by size (powers of two); a class with at
most n shingles keeps t + 1 hashes of each item, where t of n shingles may be missing, so every
item that is contained far enough has a sketch hash in the document. Hits are verified: the share
of the item's shingles that the document holds.

Items are taken in blocks of at most `BLOCK_WORDS` words, each broadcast for a pass over all
documents. Words are runs of ASCII letters and digits and of other bytes over 127, lower-cased.

Defined cases: null and empty texts hold nothing and are held by nothing; a text under `width`
words is one shingle, so a short item matches only a document of just its words; repeated items
and documents give a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import groups_of, tidy
from .ngram_join import missable

#: Words of benchmark items in one broadcast block (8 bytes a shingle).
BLOCK_WORDS = 1_000_000
FOUND = "doc_id long, item_id long, n_item long, n_shared long"

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BREAK[ord(_a) : ord(_b) + 1] = False


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = w.flatten(texts, lower=True)
    starts, ends, woff = w.split(buf, off, _BREAK)
    return w.shingles(w.hash_words(buf, starts, ends), woff, width)


class Sketches:
    """Sketch hashes of a block of items, by size class."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, width: int, percent: int) -> None:
        tokens, off = _shingles(texts, width)
        self.ids, self.percent = ids, percent
        self.sets = [tokens[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        key, item = [], []
        self.least = np.zeros(len(ids), np.int64)
        for i, s in enumerate(self.sets):
            if not len(s):
                continue
            size_class = (1 << len(s).bit_length()) - 1
            order = np.sort(w.mix(s))[: missable(size_class, percent) + 1]
            key.append(order)
            item.append(np.full(len(order), i))
            self.least[i] = -(-percent * len(s) // 100)
        self.key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.item = self.key[order], self.item[order]
        start = groups_of(self.key)
        self.distinct, self.start = self.key[start], np.append(start, len(self.key))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.distinct >> np.uint64(42)).astype(np.int64)] = True

    def leaks(self, tokens: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(document row, item row, shared shingles) of documents given by their sorted shingle sets."""
        if not len(tokens) or not len(self.distinct):
            return []
        mixed = w.mix(tokens)
        at = np.flatnonzero(self.bits[(mixed >> np.uint64(42)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.distinct, mixed[at]), len(self.distinct) - 1)
        hit = self.distinct[slot] == mixed[at]
        at, slot = at[hit], slot[hit]
        row = np.searchsorted(off, at, "right") - 1
        many = self.start[slot + 1] - self.start[slot]
        first = np.repeat(self.start[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(at) else at
        pairs = np.unique(np.stack([np.repeat(row, many), self.item[first]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        out = []
        for d, i in pairs.tolist():
            own = tokens[off[d] : off[d + 1]]
            if len(own) < self.least[i]:
                continue
            s = self.sets[i]
            place = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[place] == s).sum())
            if shared >= self.least[i]:
                out.append((d, i, shared))
        return out


def _scan(batches: Iterator[pa.RecordBatch], sketches, width: int) -> Iterator[pa.RecordBatch]:
    block = sketches.value
    for piece in w.pieces(batches):
        found = block.leaks(*_shingles(piece.column("text"), width))
        if not found:
            continue
        d, i, shared = (np.array(x, np.int64) for x in zip(*found, strict=True))
        size = np.array([len(s) for s in block.sets], np.int64)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id").take(pa.array(d)), pa.array(block.ids[i]), pa.array(size[i]), pa.array(shared)],
            names=["doc_id", "item_id", "n_item", "n_shared"],
        )


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of items held by a document to `percent` or more."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {k}"))
        table = part.toArrow()
        ids = table.column("item_id").to_numpy().astype(np.int64)
        sketches = spark.sparkContext.broadcast(Sketches(ids, table.column("text"), width, percent))
        more = docs.mapInArrow(tidy(lambda it, s=sketches: _scan(it, s, width)), FOUND)
        found = more if found is None else found.union(more)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """docs without those that hold an item; rows with a null doc_id stay."""
    leaked = find_leaks(docs, items, width, percent).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti")
