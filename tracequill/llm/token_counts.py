"""Edit-aware token counts: a segment tree over a document's pre-tokens.

A leaf holds some neighbouring pre-tokens, with their characters and tokens; an inner node the sums
of its two children. An edit finds its leaves by character sums, cuts the text again from the last
boundary that the edit can't move, and stops at the first new boundary that is an old one behind
the edit; only pre-tokens in between are encoded, and only sums on their paths change.

A pre-token's end depends on the character behind it, and for white space on what follows the whole
run of it. So the last safe boundary ends a pre-token with other characters, with the next character
untouched; and cutting from any old boundary behind the edit gives the old pre-tokens again.

Defined cases: a null or empty text has no tokens; an edit may insert, delete, reach both ends and
empty the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy, with_fields
from .words import pieces

#: Pre-tokens in a leaf when a tree is built; a leaf of four times as many rebuilds the tree.
LEAF = 32
#: Distinct pre-tokens whose counts a worker process keeps.
CACHE = 500_000


class Counter:
    """Pre-token pattern and byte-level BPE of one vocabulary; counts of distinct pre-tokens are kept."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[piece] = len(self.coder._encode_single_piece(piece))
        return got

    def counts(self, found: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, found))
        except KeyError:
            return list(map(self.count, found))


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.text = counter, text
        self.encoded = 0
        self._build(counter.pattern.findall(text))

    def _build(self, found: list[str]) -> None:
        tokens = self.counter.counts(found)
        self.leaves = max(1, -(-len(found) // LEAF))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.held = [found[i : i + LEAF] for i in range(0, len(found), LEAF)] or [[]]
        chars = np.zeros(2 * self.size, np.int64)
        sums = np.zeros(2 * self.size, np.int64)
        if found:
            cut = np.arange(0, len(found), LEAF)
            chars[self.size : self.size + len(cut)] = np.add.reduceat(np.fromiter(map(len, found), np.int64, len(found)), cut)
            sums[self.size : self.size + len(cut)] = np.add.reduceat(np.array(tokens, np.int64), cut)
        k = self.size
        while k > 1:
            chars[k // 2 : k] = chars[k : 2 * k : 2] + chars[k + 1 : 2 * k : 2]
            sums[k // 2 : k] = sums[k : 2 * k : 2] + sums[k + 1 : 2 * k : 2]
            k //= 2
        self.chars, self.sums = chars, sums

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the text's end) and the leaf's first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            left = int(self.chars[k])
            if at >= start + left and self.chars[k + 1]:
                start += left
                k += 1
        return min(k - self.size, self.leaves - 1), start

    def _put(self, leaf: int, found: list[str]) -> None:
        self.held[leaf] = found
        k = leaf + self.size
        chars = sum(map(len, found)) - int(self.chars[k])
        tokens = sum(self.counter.counts(found)) - int(self.sums[k])
        while k:
            self.chars[k] += chars
            self.sums[k] += tokens
            k //= 2

    def edit(self, start: int, end: int, put: str) -> int:
        """Replaces text[start:end]; returns the new total."""
        old = self.text
        self.text = old[:start] + put + old[end:]
        shift = len(put) - (end - start)
        first, begin = self._leaf(max(0, start - 1))
        while True:  # the last boundary that the edit can't move
            here, i, k, pieces_before = begin, first, 0, []
            while i < self.leaves:
                own = self.held[i]
                if k == len(own):
                    if i + 1 == self.leaves:
                        break
                    i, k = i + 1, 0
                    continue
                if here + len(own[k]) >= start:
                    break
                here += len(own[k])
                pieces_before.append(own[k])
                k += 1
            # White space ends where the text behind the whole run of it says.
            while pieces_before and pieces_before[-1].isspace():
                here -= len(pieces_before.pop())
                while not k:
                    i -= 1
                    k = len(self.held[i])
                k -= 1
            if pieces_before or not first:
                break
            first -= 1
            begin -= int(self.chars[first + self.size])
        # Old boundaries from there on, taken as they are needed; new pre-tokens until both meet.
        def rest():
            j, m, pos = i, k, here
            while j < self.leaves:
                own = self.held[j]
                if m == len(own):
                    j, m = j + 1, 0
                    continue
                yield pos, j, m
                pos += len(own[m])
                m += 1
            yield pos, self.leaves, 0

        olds = rest()
        pos, j, m = next(olds)
        fresh: list[str] = []
        new = here
        for match in self.counter.pattern.finditer(self.text, here):
            fresh.append(match.group())
            new = match.end()
            while pos < end or pos + shift < new:
                if j == self.leaves:
                    break
                pos, j, m = next(olds)
            if pos >= end and pos + shift == new:
                break
        else:
            while j < self.leaves:
                pos, j, m = next(olds)
        self.encoded = len(fresh)
        tail = [] if j == self.leaves else self.held[j][m:]
        stop = min(j, self.leaves - 1)
        own = pieces_before + fresh + tail
        for leaf in range(first + 1, stop + 1):
            self._put(leaf, [])
        self._put(first, own)
        if len(own) > 4 * LEAF:
            self._build([x for held in self.held for x in held])
        return self.total


_counters: dict[str, Counter] = {}


def counter(ranks_path: str, pattern: str) -> Counter:
    """The counter of this process."""
    if ranks_path not in _counters:
        _counters[ranks_path] = Counter(ranks_path, pattern)
    return _counters[ranks_path]


def masked(n: int) -> tuple[int, int, str]:
    """The edit of the query: 40 characters from the middle on, or fewer, give way to a short mark."""
    return n // 2, min(n, n // 2 + 40), "[removed]"


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, edit, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = counter(path, pattern)
    for batch in pieces(batches):
        before, after, encoded, pretokens = [], [], [], []
        for text in batch.column("text").to_pylist():
            tree = CountTree(text or "", own)
            before.append(tree.total)
            pretokens.append(sum(map(len, tree.held)))
            after.append(tree.edit(*edit(len(tree.text))) if text else 0)
            encoded.append(tree.encoded if text else 0)
        cols = zip(("n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded"), (before, pretokens, after, encoded), strict=True)
        added = {n: pa.array(v, pa.int64()) for n, v in cols}
        yield pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names=names)
    own.known.clear()


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, edit=masked) -> DataFrame:
    """docs with n_tokens, n_pretokens, and after edit(length) -> (start, end, replacement) n_tokens_edited and n_reencoded."""
    schema = with_fields(docs.schema, *((n, "long") for n in ("n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded")))
    names = schema.names
    return docs.mapInArrow(tidy(lambda it: _count(it, ranks_path, pattern, edit, names)), schema)
