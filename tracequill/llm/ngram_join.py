"""N-gram Jaccard self-join by token-combination prefixes, and its connected components.

A document's tokens are its distinct word shingles. Documents with equal sets are one set, named by
63 bits of a signature. In one order of all tokens, rare ones first, two sets over the threshold
share a token among the first t + 1 of each, where t is how many tokens a set may miss.

1. Batches report tokens that several of their documents have; the `TABLE_ROWS` commonest of these
   are broadcast and do not travel. All other tokens meet, packed, in ranges of hash space and are
   counted exactly. What only one set has goes no further; the rest goes back to its set.
2. A set whose t + 1 rarest tokens are its own has no partner. Of the others, rare tokens of the
   prefix are index keys alone. Where all rare tokens are within the prefix, it is extended over the
   frequent ones, which are keys in combinations: they are dealt into classes by hash, and a key is
   all that a set has in one class. Two sets that share no rare token differ in at most d frequent
   ones, so if more than d classes of one have tokens, one class is the same in both. The number of
   classes goes with the set size, so keys are linear in it. Should a set have tokens in too few
   classes, it adds the keys of twice as many, and so on; each set has all rounds up to its own last.
3. Groups of copies are not expanded into pairs. Keys of up to `SMALL` sets give all their pairs; of
   larger ones, within a partition and again over partitions, each set is paired with the first one.
   Of its pairs each set first has the likeliest one verified, then those still in different
   components. In keys whose sets are still not in one component, all are compared with the most
   popular one, and what is left apart there meets in all pairs that can be similar. By then sets
   have marks, parities of their tokens by hash: two sets differ in as many tokens at least as their
   marks in bits, so most pairs that are not similar go no further, and no similar one is lost.
   So no link that joins two components is missed.

If a key is what two sets share first, they share at most what either has from there on; that bounds
which pairs can do. Tokens travel with as many bits as keep chance meetings of different ones rare at
the number of tokens there are; keys only find candidates, which are verified on their full texts.

Defined cases: a null, empty or blank text has no shingles and no links; under `width` words the
whole text is one shingle; rows that share a doc_id count as one document with several texts; a
row with a null doc_id gets its size and a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import forget, groups_of, partitions, saved, tidy
from .components import components
from .packing import pack, unpack

#: Words gathered before a batch is dealt out, or its tokens counted.
BATCH_WORDS, COUNT_WORDS = 1_000_000, 1_500_000
#: The most common tokens, with their counts: 16 bytes each, broadcast.
TABLE_ROWS = 1_000_000
#: Documents of a batch that must share a token before the batch reports it, and reports in all
#: before the table has it.
LOCAL, LEAST = 2, 16
#: Tokens a task of the counting stage gets, on average.
TASK_TOKENS = 3_000_000
#: Ids (8 bytes each) up to which the rows of a round are picked by a broadcast, not a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds in which sets are compared with the most popular one of each of their keys, before what is left meets in pairs.
TOP_ROUNDS = 2
#: Words of 64 bits in a set's mark: a bit is whether an odd number of its tokens hash to it.
MARK_WORDS = 16
#: The largest index group that gives all its pairs.
SMALL = 4
#: Bytes of text that are compared at a time.
PAIR_BYTES = 2 << 20
#: Pairs with one first set that are verified in one task, about.
HUB_PAIRS = 2_000
#: Kinds of packed rows: tokens on their way to be counted, sizes and frequent tokens of sets, shared
#: tokens with counts, index entries, entries and pairs of large groups settled within a partition.
TOKENS, SETS, SHARED, INDEX, GROUP, PAIR = range(6)
ROUTED = "part int, kind int, home int, payload binary"
MET = "kind int, a long, b long, n long, payload binary"
_NONE = np.zeros(0, np.uint64)


def _sets(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = w.flatten(piece.column("text"), lower=True)
    starts, ends, woff = w.split(buf, off)
    return w.shingles(w.hash_words(buf, starts, ends), woff, width)


def _named(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The name of each set: 63 bits of its size and two sums over its tokens; 0 for an empty one."""

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        return total[off[1:]] - total[off[:-1]]

    n = np.diff(off).astype(np.uint64)
    return np.where(n > 0, w.mix(sums(tokens) + w.mix(sums(w.mix(tokens + np.uint64(w.BASES[1]))) + n)) >> np.uint64(1), np.uint64(0))


def _measured(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and name, and rows of tokens that several of a batch share."""
    names = ["doc_id", "th", "n", "sid", "token", "count"]
    held, size = [], 0

    def flush():
        keys = np.sort(np.concatenate(held))
        start = groups_of(keys)
        n = np.diff(np.append(start, len(keys)))
        often = n >= LOCAL
        k = int(often.sum())
        empty = [pa.nulls(k, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*empty, pa.array(keys[start][often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=names)

    for piece in w.pieces(batches):
        tokens, off = _sets(piece, width)
        sid, m = _named(tokens, off), piece.num_rows
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("th"), pa.array(np.diff(off).astype(np.int64)), pa.array(sid.view(np.int64), mask=sid == 0), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
            names=names,
        )
        held.append(tokens)
        size += len(tokens)
        if size >= COUNT_WORDS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def common_tokens(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest tokens and about how many documents have them."""
    top = measured.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") >= LEAST)
    top = top.orderBy(F.desc("n"), "token").limit(TABLE_ROWS).toArrow()
    token = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    count = top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


def missable(n, percent: int):
    """How many of n tokens a set may lack in any partner that is similar enough."""
    return n - (percent * n + 99) // 100


def _bands(percent: int, top: int) -> list[int]:
    """Starts of bands of set sizes: partners are in the same band or in adjoining ones."""
    found = [1]
    while found[-1] <= top:
        found.append(found[-1] * 100 // percent + 1)
    return found


def class_keys(tokens: np.ndarray, n: int, rare: int, percent: int) -> np.ndarray:
    """Keys of the frequent tokens of a set of n tokens, `rare` of which are not among them.

    A pair has its keys in the scheme of the larger one's band, so a set has those of its own band and
    the next. Sets of sizes n and m that are similar enough differ in (n + m) (100 - p) / (100 + p)
    tokens at most; rare ones that are not shared are among them.
    """
    most = n * 100 // percent
    band = _bands(percent, most * 100 // percent + 1)
    own = int(np.searchsorted(band, n, "right")) - 1
    out = []
    for scheme in (own, own + 1):
        top = band[scheme + 1] - 1
        differ = (n + min(top, most)) * (100 - percent) // (100 + percent) - rare
        if differ < 0:
            continue
        classes = max(1, 3 * top * (100 - percent) // (100 + percent))
        for level in range(40):
            seed = w.mix(np.array([scheme * 64 + level + 1], np.uint64))
            dealt = w.mix(tokens + seed)
            cls = dealt % np.uint64(classes << level)
            order = np.argsort(cls, kind="stable")
            start = groups_of(cls[order])
            sums = np.add.reduceat(w.mix(dealt[order] + np.uint64(w.BASES[0])), start)
            out.append(w.mix(sums + w.mix(cls[order][start] + seed)))
            if len(start) > differ:
                break
    return np.unique(np.concatenate(out)) if out else _NONE


def _rows(parts, kinds, payloads, homes=None) -> pa.RecordBatch:
    n = len(payloads)
    kinds = np.broadcast_to(np.asarray(kinds, np.int32), n)
    homes = pa.nulls(n, pa.int32()) if homes is None else pa.array(homes, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(parts, np.int32)), pa.array(kinds), homes, pa.array(payloads, pa.binary())], names=["part", "kind", "home", "payload"])


def _cut(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts in use; part is sorted."""
    cut = np.searchsorted(part, np.arange(parts + 1))
    return [(i, int(cut[i]), int(cut[i + 1])) for i in range(parts) if cut[i] < cut[i + 1]]


def _dealt(batches: Iterator[pa.RecordBatch], width: int, bits: int, parts: int, homes: int, table) -> Iterator[pa.RecordBatch]:
    """Tokens packed for their range of hash space; sizes and frequent tokens packed for the set's home."""
    known = table.value[0]
    hint = np.zeros(1 << 22, bool)
    hint[known >> np.uint64(42)] = True
    shift = np.uint64(64 - bits)
    held, seen, size = [], set(), 0

    def flush():
        sid = np.array([s for s, _ in held], np.uint64)
        n = np.array([len(t) for _, t in held])
        tokens = np.concatenate([t for _, t in held])
        often = hint[tokens >> np.uint64(42)]
        maybe = np.flatnonzero(often)
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens[maybe]), len(known) - 1)
            often[maybe] = known[at] == tokens[maybe]
        doc = np.repeat(np.arange(len(sid), dtype=np.int32), n)
        home = (sid % np.uint64(homes)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        common, whose = tokens[often] >> shift, doc[often]
        f = np.bincount(whose, minlength=len(sid))
        begin = np.concatenate([[0], np.cumsum(f)])
        out = []
        for h, i, j in _cut(home[by_home], homes):
            d = by_home[i:j]
            mine = np.concatenate([common[begin[x] : begin[x + 1]] for x in d])
            out.append((h, SETS, h, pack(sid[d], n[d], f[d], mine)))
        tokens, doc = tokens[~often], doc[~often]
        part = (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        tokens, doc, part = tokens[order] >> shift, doc[order], part[order]
        for p, i, j in _cut(part, parts):
            first = groups_of(doc[i:j])
            out.append((p, TOKENS, None, pack(tokens[i:j], np.diff(np.append(first, j - i)), sid[doc[i:j][first]])))
        yield _rows([x[0] % parts for x in out], [x[1] for x in out], [x[3] for x in out], [x[2] for x in out])

    for piece in w.pieces(batches):
        tokens, off = _sets(piece, width)
        names = _named(tokens, off).tolist()
        for name, a, b in zip(names, off[:-1].tolist(), off[1:].tolist(), strict=True):
            if a < b and name not in seen:
                seen.add(name)
                held.append((name, tokens[a:b]))
                size += b - a
        if size >= BATCH_WORDS:
            held.sort(key=lambda x: x[0])
            yield from flush()
            held, seen, size = [], set(), 0
    if held:
        held.sort(key=lambda x: x[0])
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """One range of hash space: what several sets share goes to their homes with its count; the rest stays behind."""
    tokens, row, sets = [], [], []
    total = 0
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        ride = kind == SETS
        if ride.any():
            keep = batch.filter(pa.array(ride))
            yield _rows(keep.column("home").to_numpy(), SETS, keep.column("payload"))
        for data in batch.filter(pa.array(~ride)).column("payload"):
            token, lengths, sid = unpack(data.as_py())
            tokens.append(token)
            row.append(np.repeat(np.arange(total, total + len(sid), dtype=np.int32 if total < 1 << 30 else np.int64), lengths.astype(np.int64)))
            sets.append(sid)
            total += len(sid)
    if not tokens:
        return
    token = np.concatenate(tokens)
    del tokens
    order = np.argsort(token, kind="stable")
    token = token[order]
    several = np.zeros(len(token) + 1, bool)
    several[1:-1] = token[1:] == token[:-1]
    several = several[1:] | several[:-1]
    token, order = token[several], order[several]
    row = np.concatenate(row)[order]
    sid = np.concatenate(sets)[row]
    del order, row, sets, several
    if not len(token):
        return
    order = np.lexsort((sid, token))
    token, sid = token[order], sid[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])  # one set from several batches is one
    token, sid = token[new], sid[new]
    start = groups_of(token)
    size = np.diff(np.append(start, len(token)))
    count = np.repeat(size, size)
    shared = count > 1
    token, sid, count = token[shared], sid[shared], count[shared]
    home = (sid % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((token, sid, home))
    token, sid, count, home = token[order], sid[order], count[order], home[order]
    out = []
    for h, i, j in _cut(home, homes):
        first = groups_of(sid[i:j])
        out.append((h, pack(sid[i:j][first], np.diff(np.append(first, j - i)), token[i:j], count[i:j])))
    if out:
        yield _rows([h for h, _ in out], SHARED, [p for _, p in out])


def _fit(n, m, most, most_m, percent: int) -> np.ndarray:
    """Whether sets of these sizes, which share no more than most and most_m, can be similar enough."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * np.minimum(most, most_m) >= percent * (n + m))


def _pairs(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (smaller name first) and the number of keys they have in common; 0 where they only must not stay apart unseen."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    keys, a, b = keys[a != b], a[a != b], b[a != b]
    order = np.lexsort((b, a))
    keys, a, b = keys[order], a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.add.reduceat(keys, at) if len(at) else keys


def _grouped(keys, sid, n, most, large, percent: int):
    """Entries of index keys -> pairs, groups of large keys by their first set, and which entries stand for their key.

    Entries sorted by key and name. large: entries that stand for a large group elsewhere.
    """
    start = groups_of(keys)
    size = np.diff(np.append(start, len(keys)))
    big = (size > SMALL) | np.logical_or.reduceat(large, start)
    hub = np.repeat(start, size)
    in_big = np.repeat(big, size)
    far = np.flatnonzero(in_big & (np.arange(len(keys)) != hub))
    left, right = [hub[far]], [far]
    for step in range(1, SMALL):
        i = np.flatnonzero((keys[:-step] == keys[step:]) & ~in_big[step:]) if step < len(keys) else far[:0]
        left.append(i)
        right.append(i + step)
    left, right = np.concatenate(left), np.concatenate(right)
    ok = _fit(n[left], n[right], most[left], most[right], percent)
    must = ok | in_big[left]
    pairs = _pairs(sid[left[must]], sid[right[must]], ok[must].astype(np.int64))
    members = np.flatnonzero(in_big)
    groups = []
    if len(members):
        order = members[np.lexsort((members, sid[hub[members]]))]
        first = sid[hub[order]]
        for i, j in zip(at := groups_of(first), np.append(at[1:], len(first)), strict=True):
            own = order[i:j]
            groups.append((first[i], pack(keys[own], sid[own], n[own], most[own])))
    stand = ~in_big
    stand[start] = True
    return pairs, groups, stand, in_big


def _prefixed(batches: Iterator[pa.RecordBatch], percent: int, frequent: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Index entries of the sets at home here; large groups are settled here but for their first set."""
    names, sizes, often, common, sid_s, token_s, count_s = [], [], [], [], [], [], []
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if kind == SETS:
                sid, n, f, tokens = unpack(data)
                names.append(sid)
                sizes.append(n.astype(np.int64))
                often.append(f.astype(np.int64))
                common.append(tokens)
            else:
                sid, lengths, token, count = unpack(data)
                sid_s.append(np.repeat(sid, lengths.astype(np.int64)))
                token_s.append(token)
                count_s.append(count.astype(np.int64))
    if not names:
        return
    names, sizes, often, common = (np.concatenate(x) for x in (names, sizes, often, common))
    begin = np.concatenate([[0], np.cumsum(often)])
    names, at = np.unique(names, return_index=True)
    sizes, often, begin, end = sizes[at], often[at], begin[at], begin[at] + often[at]
    token, count, bounds = _NONE, np.zeros(0, np.int64), np.zeros(len(names) + 1, np.int64)
    if sid_s:
        sid, token, count = (np.concatenate(x) for x in (sid_s, token_s, count_s))
        order = np.lexsort((token, count, sid))
        sid, token, count = sid[order], token[order], count[order]
        bounds = np.append(np.searchsorted(sid, names), len(sid))
    alone = sizes - often - np.diff(bounds)
    t = missable(sizes, percent)
    keys, most, row = [], [], []
    for i in np.flatnonzero(alone <= t).tolist():
        n, own = int(sizes[i]), token[bounds[i] : bounds[i + 1]]
        rare = int(np.searchsorted(count[bounds[i] : bounds[i + 1]], frequent))
        q = int(alone[i]) + rare
        single = own[: min(rare, int(t[i]) + 1 - int(alone[i]))]
        keys.append(w.mix(single + np.uint64(1)))
        most.append(n - int(alone[i]) - np.arange(len(single)))
        row.append(np.full(len(single), i))
        if q <= t[i]:
            combined = class_keys(np.concatenate([own[rare:], common[begin[i] : end[i]]]), n, q, percent)
            keys.append(combined)
            most.append(np.full(len(combined), n - q))
            row.append(np.full(len(combined), i))
    if not keys:
        return
    keys, most, row = np.concatenate(keys), np.concatenate(most), np.concatenate(row)
    if not len(keys):
        return
    order = np.lexsort((row, keys))
    keys, most, row = keys[order], most[order], row[order]
    sid, n = names[row].astype(np.int64), sizes[row]
    (a, b, shared), groups, stand, large = _grouped(keys, sid, n, most, np.zeros(len(keys), bool), percent)
    out = [(int(hub) % parts, GROUP, pack(np.array([hub]), *unpack(data))) for hub, data in groups]
    if len(a):
        out.append((int(a[0]) % parts, PAIR, pack(a, b, shared)))
    keys, sid, n, most, large = keys[stand], sid[stand], n[stand], most[stand], large[stand]
    part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    for p, i, j in _cut(part, parts):
        out.append((p, INDEX, pack(keys[i:j], sid[i:j], n[i:j] * 2 + large[i:j], most[i:j])))
    yield _rows([x[0] for x in out], [x[1] for x in out], [x[2] for x in out])


def _met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a key of this range, and the packed entries of large groups."""

    def pairs(a, b, n):
        for i in range(0, len(a), 100_000):
            j = min(len(a), i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(j - i, PAIR, np.int32)), pa.array(a[i:j].astype(np.int64)), pa.array(b[i:j].astype(np.int64)), pa.array(n[i:j].astype(np.int64)), pa.nulls(j - i, pa.binary())],
                names=["kind", "a", "b", "n", "payload"],
            )

    def group(hub, data):
        return pa.RecordBatch.from_arrays([pa.array([GROUP], pa.int32()), pa.array([int(hub)], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())], names=["kind", "a", "b", "n", "payload"])

    held = []
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            cols = unpack(data)
            if kind == PAIR:
                yield from pairs(*cols)
            elif kind == GROUP:
                yield group(cols[0][0], pack(*cols[1:]))
            else:
                held.append(cols)
    if not held:
        return
    keys, sid, n, most = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((sid, keys))
    keys, sid, n, most = keys[order], sid[order].astype(np.int64), n[order].astype(np.int64), most[order].astype(np.int64)
    found, groups, _, _ = _grouped(keys, sid, n >> 1, most, (n & 1).astype(bool), percent)
    yield from pairs(*found)
    for hub, data in groups:
        yield group(hub, data)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of packed groups, a row each."""
    for batch in batches:
        for data in batch.column("payload").to_pylist():
            cols = [x.view(np.int64) for x in unpack(data)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "sid", "n", "most"])


def _marked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The mark of each text's set."""
    bits = 64 * MARK_WORDS
    for piece in w.pieces(batches):
        tokens, off = _sets(piece, width)
        doc = np.repeat(np.arange(piece.num_rows), np.diff(off))
        odd = np.bincount(doc * bits + (w.mix(tokens + np.uint64(w.BASES[1])) % np.uint64(bits)).astype(np.int64), minlength=piece.num_rows * bits) & 1
        marks = np.packbits(odd.astype(np.uint8)).view(np.int64)
        held = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * MARK_WORDS), pa.array(marks))
        yield pa.RecordBatch.from_arrays([piece.column("sid"), held], names=["sid", "mark"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for shuffles."""
    coder = zstandard.ZstdCompressor(level=3)
    for piece in w.pieces(batches):
        data = [coder.compress(t or b"") for t in piece.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("sid"), pa.array(data, pa.binary())], names=["sid", "z"])


def _similar(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar enough, by the sets of their whole texts; each text of a stretch of pairs is read once."""
    coder = zstandard.ZstdDecompressor()
    held, texts, size = [], {}, 0

    def flush():
        at = {s: k for k, s in enumerate(texts)}
        x, xo = _sets(pa.RecordBatch.from_arrays([pa.array(list(texts.values()), pa.binary())], names=["text"]), width)
        found = []
        for a, b in held:
            p, q = (x[xo[at[k]] : xo[at[k] + 1]] for k in (a, b))
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both > 0 and 100 * both >= percent * (len(p) + len(q) - both):
                found.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(n) for n in ("a", "b", "z_a", "z_b")]
        for i in range(batch.num_rows):
            a, b, z_a, z_b = (c[i].as_py() for c in columns)
            for k, z in ((a, z_a), (b, z_b)):
                if k not in texts:
                    texts[k] = coder.decompress(z)
                    size += len(texts[k])
            held.append((a, b))
            if size >= PAIR_BYTES:
                yield flush()
                held, texts, size = [], {}, 0
    if held:
        yield flush()


def _picked(rows: DataFrame, wanted: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """rows joined with wanted: by a broadcast if those are few, else by a shuffle. wanted is a saved table."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, on, how)


def near_components(docs: DataFrame, width: int = 5, percent: int = 75, frequent: int = 16) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), one row per input row.

    frequent: sets that must share a token before it is indexed in combinations only. It moves work
    between two exact ways of finding candidates, both linear in a set's size.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    measured = saved(docs.mapInArrow(tidy(lambda it: _measured(it, width)), "doc_id long, th long, n long, sid long, token long, count long"))
    stats = measured.filter("n is not null").select("doc_id", "th", "n", "sid")
    table = spark.sparkContext.broadcast(common_tokens(measured))
    total = stats.agg(F.sum("n")).first()[0] or 0
    bits = min(64, max(32, total.bit_length() + 12))
    ranges, homes = max(parts, total // TASK_TOKENS), max(parts, total // (2 * TASK_TOKENS))

    dealt = docs.filter("doc_id is not null").select("text").mapInArrow(tidy(lambda it: _dealt(it, width, bits, ranges, homes, table)), ROUTED)
    shared = dealt.repartitionById(ranges, F.col("part")).mapInArrow(tidy(lambda it: _counted(it, homes)), ROUTED)
    index = shared.repartitionById(homes, F.col("part")).mapInArrow(tidy(lambda it: _prefixed(it, percent, frequent, parts)), ROUTED)
    met = saved(index.repartitionById(parts, F.col("part")).mapInArrow(tidy(lambda it: _met(it, percent)), MET))
    pairs = saved(met.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")))
    groups = met.filter(F.col("kind") == GROUP).select(F.col("a").alias("hub"), "payload")

    ids = stats.filter("sid is not null and doc_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).filter("a < z").select("doc_id", "a")
    links = saved(ids.join(several, "doc_id").filter("a < sid").select("a", F.col("sid").alias("b")).distinct())

    def with_texts(wanted: DataFrame) -> DataFrame:
        """The sets (sid) of a saved table with a text of each; in repeated rows several times."""
        one = saved(_picked(ids, wanted, "sid").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("d")).select("sid", "d.doc_id", "d.th"))
        return _picked(docs, one, ["doc_id", "th"], "inner")

    def verified(todo: DataFrame) -> DataFrame:
        wanted = saved(todo.select(F.col("a").alias("sid")).union(todo.select("b")).distinct())
        texts = with_texts(wanted).mapInArrow(tidy(_zipped), "sid long, z binary").dropDuplicates(["sid"])
        hubs = todo.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("k"))
        salt = F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt")
        first = texts.toDF("a", "z_a").join(hubs, "a").select("a", "z_a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
        second = todo.select("a", "b").join(hubs, "a").select("a", "b", salt).join(texts.toDF("b", "z_b"), "b")
        both = second.join(first, ["a", "salt"]).select("a", "b", "z_a", "z_b")
        return saved(both.mapInArrow(tidy(lambda it: _similar(it, width, percent)), "a long, b long"))

    def likeliest(some: DataFrame) -> DataFrame:
        """Of each b the pair with the most keys, the smallest a of equal ones."""
        best = some.filter("n > 0").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best"))
        return best.select((-F.col("best.a")).alias("a"), "b")

    tested = saved(likeliest(pairs))
    labels = entries = marks = None
    if not tested.isEmpty():
        links = links.union(verified(tested))
    if not links.isEmpty():
        labels = components(links)
        rest = saved(labelled(pairs.filter("n > 0"), labels).select("a", "b").join(tested, ["a", "b"], "left_anti"))
    else:
        rest = saved(pairs.filter("n > 0").select("a", "b").join(tested, ["a", "b"], "left_anti"))
    for step in ("rest", *["top"] * TOP_ROUNDS, "all"):
        if step == "rest":
            todo = rest
        else:
            if labels is None:
                labels = saved(ids.limit(0).select(F.col("sid").alias("id"), F.col("sid").alias("component")))
            if entries is None:
                hubs = saved(labelled(pairs, labels).select(F.explode(F.array("a", "b")).alias("hub")).distinct())
                if hubs.isEmpty():
                    break
                keys = saved(_picked(groups, hubs, "hub").select("payload").mapInArrow(tidy(_opened), "key long, sid long, n long, most long").select("key").distinct())
                entries = _picked(groups.select("payload").mapInArrow(tidy(_opened), "key long, sid long, n long, most long"), keys, "key").distinct()
            entries = saved(apart(entries, labels))
            if entries.isEmpty():
                break
            if marks is None:
                marks = saved(with_texts(saved(entries.select("sid").distinct())).mapInArrow(tidy(lambda it: _marked(it, width)), "sid long, mark array<long>").dropDuplicates(["sid"]))
            marked = entries.join(marks, "sid").select("key", "sid", "n", "most", "label", "mark")
            left, right = marked.toDF("key", "a", "n_a", "most_a", "label_a", "mark_a"), marked.toDF("key", "b", "n_b", "most_b", "label_b", "mark_b")
            if step == "top":
                top = saved(popular(entries))
                left = left.join(top.toDF("key", "a"), ["key", "a"], "left_semi")
                entries = entries.join(top, ["key", "sid"], "left_anti")
            todo = left.join(right, "key").filter("label_a <> label_b" if step == "top" else "label_a <> label_b and a < b").filter(fit("n_a", "n_b", "most_a", "most_b", percent)).filter(near("n_a", "n_b", "mark_a", "mark_b", percent))
            todo = saved(todo.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
            entries = entries.select("key", "sid", "n", "most")
        if todo.isEmpty():
            continue
        more = verified(todo)
        tested = saved(tested.union(todo))
        if not more.isEmpty():
            labels = merged(labels, more)
    forget(spark, met, pairs)

    # Only sets that are linked, or that several rows have, differ from "itself": the rest needs no join.
    least = ids.groupBy("sid").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    if labels is not None:
        named = least.join(labels.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        low = named.groupBy("component").agg(F.min("least").alias("low"), F.max("last").alias("high")).filter("low < high")
        named = named.join(low, "component").select("sid", "low")
    else:
        named = least.filter("least < last").select("sid", F.col("least").alias("low"))
    named = saved(named)
    out = stats.join(named, "sid", "left").select("doc_id", "n", "sid", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
    # A text without shingles takes the component of its document's other texts.
    blank = saved(out.filter("sid is null and doc_id is not null").select("doc_id").distinct())
    if not blank.isEmpty():
        other = saved(_picked(out.filter("sid is not null"), blank, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("other")))
        if not other.isEmpty():
            out = out.join(other, "doc_id", "left").withColumn("component_id", F.when(F.col("sid").isNull(), F.coalesce("other", "component_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def fit(n: str, m: str, most: str, most_m: str, percent: int) -> Column:
    """_fit over columns."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND {100 + percent} * least({most}, {most_m}) >= {percent} * ({n} + {m})")


def near(n: str, m: str, mark: str, other: str, percent: int) -> Column:
    """Whether sets of these sizes and marks can be similar enough: they may differ in (n + m) (100 - p) / (100 + p) tokens."""
    apart = " + ".join(f"bit_count({mark}[{i}] ^ {other}[{i}])" for i in range(MARK_WORDS))
    return F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * ({n} + {m})")


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets are in different components."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (id, component) after more links: components of components, over the new links alone."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = saved(more.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    fresh = ends.select(F.col("a").alias("id"), F.col("la").alias("component")).union(ends.select("b", "lb")).distinct().join(labels.select("id"), "id", "left_anti")
    step = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("component", "next")
    return saved(labels.unionByName(fresh).join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")))


def popular(entries: DataFrame) -> DataFrame:
    """(key, sid) of the set of each key that has the largest groups over all its keys: what others were copied from has all keys that any copy has kept."""
    size = entries.groupBy("key").agg(F.count("*").alias("size"))
    liked = entries.join(size, "key").groupBy("sid").agg(F.sum("size").alias("liked"))
    return entries.join(liked, "sid").groupBy("key").agg(F.max(F.struct("liked", "sid")).alias("top")).select("key", "top.sid")


def apart(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Index entries with their sets' components, of the keys that still hold more than one."""
    found = labels.select(F.col("id").alias("sid"), "component")
    here = index.join(found, "sid", "left").select("key", "sid", "n", "most", F.coalesce("component", "sid").alias("label"))
    mixed = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return here.join(mixed, "key", "left_semi")
