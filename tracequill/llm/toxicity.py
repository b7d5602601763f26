"""Toxicity: a convolutional text classifier trained in numpy, inside Spark tasks, on all labelled texts.

Words (runs of letters and digits, lower-cased) hash into `BUCKETS` buckets. Buckets that at least
`LEAST_DOCS` training texts hit have an embedding, started from the log odds of label 1; the others
count as unknown (zero). Filters over one, two and three words with max pooling over the whole text
feed a logistic layer. Scoring multiplies each distinct word of a stretch of text with the filters
once, so a word costs a few row lookups whatever its text's length.

The language of a text is guessed from the same hashed words (a naive Bayes table learned from the
training rows' lang). Each language has its own threshold, the logit with the best F1 on rows kept
from training, of steps of 1 / `STEPS`; scores are shifted so that it stands at 0.7.

Every labelled row and its whole text is used: three quarters of the rows fit the weights, a quarter
(by a hash of doc_id) sets the thresholds, and the languages are learned from both. The rows lie in
shards of about `SHARD_ROWS`. Counts are summed over shards by ranges of buckets; in each epoch all
shards start from the same weights, and a weight moves by the mean over the shards that touched it,
weighted by their rows. Only what the size of the model bounds passes through the driver.

Defined cases: null and empty texts score as texts of padding; without labels of both kinds every
score is the share of label 1 (0.0 without labels).
"""

from __future__ import annotations

import copy
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import forget, groups_of, partitions, release, saved, tidy, with_fields
from .decontaminate import _BREAK
from .packing import pack, unpack

BUCKETS, WIDTH, FILTERS, TAPS = 1 << 22, 8, 8, (1, 2, 3)
LEAST_DOCS = 3
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
CUT = 0.7
#: Steps of a logit that thresholds are told apart by, in one.
STEPS = 256
#: Rows in a shard, about, and the words after which a shard is closed all the same.
SHARD_ROWS, SHARD_WORDS = 4000, 8_000_000
#: Labelled rows up to which documents are picked by a broadcast, not a shuffle.
BROADCAST_LABELS = 1_000_000
#: Words whose filter values are held at a time.
WINDOW = 1 << 17


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, two of padding (bucket 0) after each text, and the texts' offsets."""
    buf, off = w.flatten(texts, lower=True)
    starts, ends, woff = w.split(buf, off, _BREAK)
    own = (w.hash_words(buf, starts, ends) % w.U64(BUCKETS - 1)).astype(np.int32) + 1
    n = np.diff(woff)
    out = np.zeros(len(own) + 2 * len(n), np.int32)
    ends = np.cumsum(n + 2)
    shift = np.repeat(2 * np.arange(len(n)), n)
    out[np.arange(len(own)) + shift] = own
    return out, np.concatenate([[0], ends])


class Shard(NamedTuple):
    """Labelled texts: buckets of their words, offsets, labels, languages (-1: none), and which are kept from training."""

    ids: np.ndarray
    off: np.ndarray
    y: np.ndarray
    lang: np.ndarray
    kept: np.ndarray


class Model:
    """Weights, and what scoring needs of them."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.active = np.zeros(0, np.int32)  # sorted buckets; row k + 1 of the embeddings is active[k]'s
        self.emb = np.zeros((1, WIDTH), np.float32)
        self.squares = np.zeros(1, np.float32)
        self.taps = {t: rng.normal(0, 0.3, (t, WIDTH, FILTERS)).astype(np.float32) for t in TAPS}
        self.bias = {t: np.zeros(FILTERS, np.float32) for t in TAPS}
        self.out = rng.normal(0, 0.1, len(TAPS) * FILTERS).astype(np.float32)
        self.const = np.zeros(1, np.float32)
        self.slots = [(np.zeros_like(v), np.zeros_like(v)) for v in self.dense()]
        self.step = np.zeros(1, np.float32)
        self.langs: list[str] = []
        self.lang_table = np.zeros((1, 0), np.float32)
        self.cut = np.zeros(1, np.float32)
        self.flat: float | None = None
        self.row_of = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"row_of": None}

    def dense(self) -> list[np.ndarray]:
        """The weights besides the embeddings."""
        return [self.out, self.const, *self.bias.values(), *self.taps.values()]

    def state(self) -> list[np.ndarray]:
        """All that the shards' passes average whole: weights, their moments, and the number of steps."""
        return [*self.dense(), *(x for pair in self.slots for x in pair), self.step]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Embedding rows of buckets; 0 for padding and unknown ones."""
        if self.row_of is None:
            self.row_of = np.zeros(BUCKETS + 1, np.int32)
            self.row_of[self.active] = np.arange(1, len(self.active) + 1)
        return self.row_of[ids]

    def conv(self, ids: np.ndarray, pads: np.ndarray) -> dict[int, np.ndarray]:
        """Filter values at every position, by the filters' width; at pads, the texts' paddings, of padding alone.

        A word's values are sums in a fixed order, so they do not depend on what else is in a batch.
        """
        found, at = np.unique(ids, return_inverse=True)
        e, out = self.emb[found], {}
        for t in TAPS:
            for j, tap in enumerate(self.taps[t]):
                table = e[:, :1] * tap[0]
                for k in range(1, WIDTH):
                    table += e[:, k : k + 1] * tap[k]
                if j:
                    total[:-j] += table[at[j:]]
                else:
                    total = table[at] + self.bias[t]
            total[pads] = self.bias[t]
            out[t] = total
        return out

    def read(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text, and the row of its likeliest language."""
        n = len(off) - 1
        pooled, likely = np.zeros((n, len(TAPS) * FILTERS), np.float32), np.zeros((n, max(1, len(self.langs))))
        for i in range(0, len(ids), WINDOW):
            j = min(len(ids), i + WINDOW)
            first, last = int(np.searchsorted(off, i, "right")) - 1, int(np.searchsorted(off, j))
            starts = np.maximum(off[first:last] - i, 0)
            pads = (off[first + 1 : last + 1, None] - (1, 2)).ravel() - i
            part = ids[i : j + max(TAPS) - 1]
            values = self.conv(part, pads[(pads >= 0) & (pads < len(part))])
            top = np.concatenate([np.maximum.reduceat(values[t][: j - i], starts, axis=0) for t in TAPS], 1)
            pooled[first:last] = np.maximum(pooled[first:last], top)
            if len(self.langs) > 1:
                likely[first:last] += np.add.reduceat(self.lang_table[part[: j - i]].astype(np.float64), starts, axis=0)
        return (pooled * self.out).sum(1) + self.const, np.argmax(likely, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        ids, off = buckets(texts)
        logits, guess = self.read(self.rows(ids), off)
        shifted = logits - self.cut[guess] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -40, 40)))


def _gradients(m: Model, ids: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list, tuple]:
    """Slopes of the dense weights, and rows and slopes of the embeddings."""
    n = len(y)
    doc_of = np.repeat(np.arange(n), np.diff(off))
    values = m.conv(ids, (off[1:, None] - (1, 2)).ravel())
    pooled, places = [], {}
    for t in TAPS:
        c = values[t]
        top = np.maximum.reduceat(c, off[:-1], axis=0)
        row, col = np.nonzero(c == top[doc_of])
        place = np.zeros((n, FILTERS), np.int64)
        place[doc_of[row[::-1]], col[::-1]] = row[::-1]  # the first of equal ones
        places[t] = place
        pooled.append(top)
    raw = np.concatenate(pooled, 1)
    active = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-(active @ m.out + m.const)))
    err = ((p - y) * weight / n).astype(np.float32)
    bias, taps, touched, slope = [], [], [], []
    back = (err[:, None] * m.out[None]) * (raw > 0)
    for k, t in enumerate(TAPS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        bias.append(g.sum(0))
        grad = np.zeros_like(m.taps[t])
        padding = places[t] >= off[1:, None] - 2
        for j in range(t):
            at = np.where(padding, 0, ids[np.minimum(places[t] + j, len(ids) - 1)])
            grad[j] = np.einsum("nf,nfw->wf", g, m.emb[at])
            touched.append(at.ravel())
            slope.append((g[:, :, None] * m.taps[t][j].T[None]).reshape(-1, WIDTH))
        taps.append(grad)
    row, where = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(row), WIDTH), np.float32)
    np.add.at(total, where, np.concatenate(slope))
    return [active.T @ err, err.sum(keepdims=True), *bias, *taps], (row[row > 0], total[row > 0])


def _pass(m: Model, shard: Shard, weight: tuple[float, float], epoch: int, number: int) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray] | None:
    """One epoch over a shard from the weights of m: its training rows, the state after it, embedding rows and their changes.

    The last column of the changes is that of the rows' sums of squares.
    """
    train = np.flatnonzero(~shard.kept)
    if not len(train):
        return None
    used, ids = np.unique(np.append(np.int32(0), m.rows(shard.ids)), return_inverse=True)
    ids = ids[1:].astype(np.int32)
    own = Model(np.random.default_rng(SEED))
    own.emb, own.squares = m.emb[used], m.squares[used]
    for a, b in zip(own.state(), m.state(), strict=True):
        a[...] = b
    order = np.random.default_rng((SEED, epoch, number)).permutation(train)
    for i in range(0, len(order), BATCH):
        part = order[i : i + BATCH]
        docs = [ids[shard.off[k] : shard.off[k + 1]] for k in part]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        own.step += 1
        step = float(own.step[0])
        y = shard.y[part]
        grads, (row, g) = _gradients(own, np.concatenate(docs), off, y, np.where(y == 1, *weight))
        own.squares[row] += (g * g).mean(1)
        own.emb[row] -= RATE * g / (np.sqrt(own.squares[row])[:, None] + 1e-6)
        for value, (a, b), g in zip(own.dense(), own.slots, grads, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    change = np.concatenate([own.emb - m.emb[used], (own.squares - m.squares[used])[:, None]], 1)
    touched = change.any(1)
    return len(train), own.state(), used[touched], change[touched]


def _mean(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the means of their changes over the parts (weight, rows, changes) that have them."""
    row, where = np.unique(np.concatenate([r for _, r, _ in parts]), return_inverse=True)
    total, share, at = np.zeros((len(row), parts[0][2].shape[1])), np.zeros(len(row)), 0
    for n, r, change in parts:
        here, at = where[at : at + len(r)], at + len(r)
        total[here] += n * change.astype(np.float64)  # a part has a row once
        share[here] += n
    return row.astype(np.int32), (total / share[:, None]).astype(np.float32)


def _moved(m: Model, state: np.ndarray | None, rows: np.ndarray, change: np.ndarray) -> None:
    """The mean state and changes of an epoch, put into the model."""
    if state is not None:
        at = 0
        for x in m.state():
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
    m.emb[rows] += change[:, :WIDTH]
    m.squares[rows] += change[:, WIDTH]


def _flat(state: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in state])


def _hits(shard: Shard) -> tuple[np.ndarray, ...]:
    """Buckets with the training texts and those of label 1 that hit them; (bucket, language) with how often it comes."""
    doc = np.repeat(np.arange(len(shard.y)), np.diff(shard.off))
    train = ~shard.kept[doc]
    seen = np.unique((shard.ids[train].astype(np.int64) << 32) | doc[train])
    bucket, at = np.unique(seen >> 32, return_inverse=True)
    count, toxic = np.bincount(at, minlength=len(bucket)), np.bincount(at, shard.y[seen & 0xFFFFFFFF], minlength=len(bucket)).astype(np.int64)
    known = shard.lang[doc] >= 0
    pair, times = np.unique((shard.ids[known].astype(np.int64) << 32) | shard.lang[doc[known]], return_counts=True)
    return bucket, count, toxic, pair >> 32, pair & 0xFFFFFFFF, times


def _frequent(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """_hits of several shards summed, of the buckets that get an embedding."""
    bucket, count, toxic, word, lang, times = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    bucket, at = np.unique(bucket, return_inverse=True)
    count, toxic = (np.bincount(at, x, minlength=len(bucket)).astype(np.int64) for x in (count, toxic))
    usable = (count >= LEAST_DOCS) & (bucket > 0)
    bucket, count, toxic = bucket[usable], count[usable], toxic[usable]
    here = np.isin(word, bucket)
    pair, at = np.unique((word[here] << 32) | lang[here], return_inverse=True)
    return bucket, count, toxic, pair >> 32, pair & 0xFFFFFFFF, np.bincount(at, times[here], minlength=len(pair)).astype(np.int64)


def _begun(hits: tuple[np.ndarray, ...], total: int, bad: int, langs: list[str]) -> Model:
    """The model before its first epoch: total training rows, bad of them of label 1."""
    rng = np.random.default_rng(SEED)
    m = Model(rng)
    bucket, count, toxic, word, lang, times = hits
    m.active = bucket.astype(np.int32)
    odds = np.log((toxic + 0.5) / (bad + 1)) - np.log((count - toxic + 0.5) / (total - bad + 1))
    m.emb = np.concatenate([m.emb, rng.normal(0, 0.05, (len(bucket), WIDTH)).astype(np.float32)])
    m.emb[1:, 0] = odds / 2
    m.squares = np.zeros(len(m.emb), np.float32)
    m.langs = langs
    m.lang_table = np.zeros((len(m.emb), len(langs)), np.float32)
    row = m.rows(word)
    for k in range(len(langs)):
        seen = np.ones(len(m.emb))
        seen[row[lang == k]] += times[lang == k]
        m.lang_table[1:, k] = np.log(seen / seen.sum())[1:]
    return m


def _histogram(m: Model, shard: Shard) -> list[np.ndarray]:
    """(kept, guessed language, step of the logit) of the texts, with how many there are and how many of label 1."""
    logits, guess = m.read(m.rows(shard.ids), shard.off)
    step = np.floor(np.clip(logits.astype(np.float64), -40, 40) * STEPS).astype(np.int64) + 40 * STEPS
    key, at = np.unique((((guess << 1) | shard.kept) << 32) | step, return_inverse=True)
    return [(key >> 32) & 1, key >> 33, (key & 0xFFFFFFFF) - 40 * STEPS, np.bincount(at, minlength=len(key)), np.bincount(at, shard.y, minlength=len(key)).astype(np.int64)]


def _thresholds(m: Model, kept, guess, step, n, ones) -> None:
    """Sets the thresholds by _histogram of all shards: by the rows kept from training, or by all if none of these has label 1."""
    m.cut = np.zeros(max(1, len(m.langs)), np.float32)
    if ones[kept == 1].sum():
        guess, step, n, ones = (x[kept == 1] for x in (guess, step, n, ones))
    overall = best_cut(step, n, ones)
    for k in range(len(m.cut)):
        own = guess == k
        m.cut[k] = best_cut(step[own], n[own], ones[own]) if ones[own].sum() >= 20 else overall


def best_cut(step: np.ndarray, n: np.ndarray, ones: np.ndarray) -> float:
    """The logit with the best F1: midway between the last accepted and the first rejected step."""
    if not len(step) or not ones.sum():
        return 0.0
    s, at = np.unique(-step, return_inverse=True)
    n, ones = np.bincount(at, n), np.bincount(at, ones)
    f1 = 2 * np.cumsum(ones) / (np.cumsum(n) + ones.sum())
    k = int(np.argmax(f1))
    return float((-s[k] - s[k + 1] + 1) / 2 / STEPS if k + 1 < len(s) else -s[k] / STEPS)


def fit(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None]) -> Model:
    """A model from bucketed texts, labels and languages in memory: what train() does, with one shard."""
    if len(docs) == 0 or y.min() == y.max():
        m = Model(np.random.default_rng(SEED))
        m.flat = float(y.mean()) if len(docs) else 0.0
        return m
    names = sorted({x for x in langs if x})
    number = {x: k for k, x in enumerate(names)}
    kept = np.random.default_rng(SEED).random(len(docs)) < 0.25
    lang = np.array([number.get(x, -1) for x in langs])
    shard = Shard(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.asarray(y, float), lang, kept)
    m = _begun(_frequent([_hits(shard)]), int((~kept).sum()), int(y[~kept].sum()), names)
    weight = len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))
    for epoch in range(EPOCHS):
        got = _pass(m, shard, weight, epoch, 0)
        if got:
            n, state, rows, change = got
            _moved(m, _flat(state), rows, change)
    _thresholds(m, *_histogram(m, shard))
    return m


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "y", "lang", "kept"]
    for batch in w.pieces(batches):
        ids, off = buckets(batch.column("text"))
        held = pa.array([ids[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), held], names=[*names, "ids"])


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a part, in order, as shards."""
    held: list[tuple] = []
    size = made = 0

    def flush():
        part, y, lang, kept, ids = zip(*held, strict=True)
        y, kept = np.array(y), np.array(kept)
        row = [[part[0]], [made], [len(y)], [int(y.sum())], [int((~kept).sum())], [int(y[~kept].sum())], [y.tolist()], [list(lang)], [kept.tolist()], [[len(x) // 4 for x in ids]], [b"".join(ids)]]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=SHARD_NAMES)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "y", "lang", "kept", "ids")), strict=True):
            held.append(row)
            size += len(row[-1]) // 4
            if size >= SHARD_WORDS:
                yield flush()
                held, size, made = [], 0, made + 1
    if held:
        yield flush()


SHARDS = "part int, number int, n long, ones long, n_train long, ones_train long, y array<int>, lang array<string>, kept array<boolean>, size array<int>, ids binary"
SHARD_NAMES = [x.split()[0] for x in SHARDS.split(", ")]


def _shards(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[tuple[int, int, Shard]]:
    number = {x: k for k, x in enumerate(langs)}
    for batch in batches:
        for i in range(batch.num_rows):
            part, k, y, lang, kept, size, ids = (batch.column(c)[i].as_py() for c in ("part", "number", "y", "lang", "kept", "size", "ids"))
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            yield part, k, Shard(np.frombuffer(ids, np.int32), off, np.array(y, float), np.array([number.get(x, -1) for x in lang]), np.array(kept, bool))


def _sent(part: int, number: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(found)
    columns = [pa.array([r for r, _ in found], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([d for _, d in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["range", "part", "number", "data"])


SENT = "range int, part int, number int, data binary"


def _in_order(group: pa.Table) -> list[bytes]:
    return group.sort_by([("part", "ascending"), ("number", "ascending")]).column("data").to_pylist()


def _answer(group: pa.Table, data: bytes) -> pa.Table:
    return pa.table({"range": group.column("range")[:1], "data": pa.array([data], pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch], langs: list[str], ranges: int) -> Iterator[pa.RecordBatch]:
    """_hits of each shard, cut by ranges of buckets."""
    edges = np.arange(ranges + 1) * (BUCKETS + 1) // ranges
    for part, number, shard in _shards(batches, langs):
        bucket, count, toxic, word, lang, times = _hits(shard)
        a, b = np.searchsorted(bucket, edges), np.searchsorted(word, edges)
        cut = [(slice(a[k], a[k + 1]), slice(b[k], b[k + 1])) for k in range(ranges)]
        yield _sent(part, number, [(k, pack(bucket[x], count[x], toxic[x], word[z], lang[z], times[z])) for k, (x, z) in enumerate(cut)])


def _passed(batches: Iterator[pa.RecordBatch], shared, weight: tuple[float, float], epoch: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """_pass of each shard: its state as range -1, its changes cut by ranges of rows."""
    m = shared.value
    for part, number, shard in _shards(batches, m.langs):
        got = _pass(m, shard, weight, epoch, (part << 20) + number)
        if got:
            n, state, rows, change = got
            place = rows.astype(np.int64) * ranges // len(m.emb)
            found = [(-1, _changes(n, np.zeros(1, np.int32), _flat(state)[None]))]
            for i, j in zip(at := groups_of(place), np.append(at[1:], len(rows)), strict=True):
                found.append((int(place[i]), _changes(n, rows[i:j], change[i:j])))
            yield _sent(part, number, found)


def _changes(n: int, rows: np.ndarray, change: np.ndarray) -> bytes:
    return struct.pack("<QQ", n, len(rows)) + rows.astype("<i4").tobytes() + change.astype("<f4").tobytes()


def _changed(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    n, k = struct.unpack_from("<QQ", data)
    return n, np.frombuffer(data, "<i4", k, 16), np.frombuffer(data, "<f4", offset=16 + 4 * k).reshape(k, -1)


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for _, _, shard in _shards(batches, shared.value.langs):
        columns = _histogram(shared.value, shard)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns], names=["kept", "guess", "step", "n", "ones"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text, lang) and labels (doc_id, toxic): of all their rows with a label, 0 or 1."""
    spark = docs.sparkSession
    known = saved(labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    n_known = known.count()
    parts = max(1, -(-n_known // SHARD_ROWS))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(known) if n_known <= BROADCAST_LABELS else known, "doc_id")
    dealt, kept = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0
    rows = rows.select(dealt.alias("part"), "doc_id", "y", "lang", kept.alias("kept"), "text")
    rows = rows.mapInArrow(tidy(_bucketed), "part int, doc_id long, y int, lang string, kept boolean, ids binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "lang")
    shards = saved(rows.mapInArrow(tidy(_sharded), SHARDS))
    n, ones, total, bad = shards.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "ones", "n_train", "ones_train"))).first()
    if not 0 < ones < n:
        m = Model(np.random.default_rng(SEED))
        m.flat = ones / n if n else 0.0
        forget(spark, known, shards)
        return m
    langs = sorted(r.x for r in shards.select(F.explode(F.array_distinct("lang")).alias("x")).filter("x <> ''").distinct().collect())
    ranges = partitions(spark)
    hits = shards.mapInArrow(tidy(lambda it: _counts(it, langs, ranges)), SENT)
    hits = hits.groupBy("range").applyInArrow(tidy_merge(lambda x: pack(*_frequent([unpack(d) for d in x]))), "range int, data binary").toArrow()
    hits = [np.concatenate(x).astype(np.int64) for x in zip(*(unpack(d) for d in hits.sort_by("range").column("data").to_pylist()), strict=True)]
    m = _begun(tuple(hits), total, bad, langs)
    weight = n / (2 * ones), n / (2 * (n - ones))
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(m)
        passed = shards.mapInArrow(tidy(lambda it, s=shared, e=epoch: _passed(it, s, weight, e, ranges)), SENT)
        passed = passed.groupBy("range").applyInArrow(tidy_merge(lambda x: _changes(0, *_mean([_changed(d) for d in x]))), "range int, data binary").toArrow()
        for place, data in zip(passed.column("range").to_pylist(), passed.column("data").to_pylist(), strict=True):
            _, row, change = _changed(data)
            if place < 0:
                _moved(m, change[0], row[:0], np.zeros((0, WIDTH + 1), np.float32))
            else:
                _moved(m, None, row, change)
        shared.destroy()
    shared = spark.sparkContext.broadcast(m)
    found = shards.mapInArrow(tidy(lambda it: _scored(it, shared)), "kept long, guess long, step long, n long, ones long")
    found = found.groupBy("kept", "guess", "step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()
    shared.destroy()
    _thresholds(m, *(found.column(c).to_numpy() for c in ("kept", "guess", "step", "n", "ones")))
    forget(spark, known, shards)
    return m


def tidy_merge(step):
    """A grouped function that has the group's data in the order of their shards merged by step."""

    def run(group):
        try:
            return _answer(group, step(_in_order(group)))
        finally:
            release()

    return run


def _score(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    m = shared.value
    for batch in w.pieces(batches, 1 << 20):
        score = m.scores(batch.column("text"))
        added = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= CUT).astype(np.int32))}
        yield pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names=names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any more columns) with score and predicted, replacing columns so named."""
    light = copy.copy(model)
    light.squares, light.slots = model.squares[:1], []  # these are for training alone
    shared = docs.sparkSession.sparkContext.broadcast(light)
    schema = with_fields(docs.schema, ("score", "double"), ("predicted", "int"))
    names = schema.names
    return docs.mapInArrow(tidy(lambda it: _score(it, shared, names)), schema)
