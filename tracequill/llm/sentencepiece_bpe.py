"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Text is escaped (space to U+2581, one in front) and cut where a run of U+2581 begins; no piece of
a supported model reaches over such a cut, so segments encode alone and each distinct segment of
a batch encodes once. Its symbols lie in one flat array. A round looks up the piece that each
neighbouring pair would make, takes the least rank of each segment, merges its pairs of that rank
from the left, and compacts; segments without a pair to merge are done. Characters outside the
vocabulary become byte pieces.

Defined cases: a null or empty text encodes to the end id alone and decodes to an empty string.
Control, unknown and byte pieces are never matched in text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy, with_fields
from .words import mix, pieces

SPACE = "▁"
_MARK = SPACE.encode()
#: Bytes of text that are cut into segments at a time, and characters of segments that are merged at a time.
TEXT_BYTES, MERGED = 1 << 19, 1 << 17
#: Bytes of distinct segments, about, kept between a task's texts; dropped at its end, as workers serve other stages next.
CACHE_BYTES = 48 << 20
#: Bytes that a kept segment takes besides its name, decimal ids and decoded bytes: the objects and their places.
ENTRY_BYTES = 300


class _Pairs:
    """(left symbol, right symbol) -> merged piece, in an open-addressing table."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slot = (mix(keys.view(np.uint64)) & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            _, one = np.unique(slot[left][free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & int(self.mask)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20) | b
        slot = (mix(keys.view(np.uint64)) & self.mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[slot[left]]
            hit = got == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (got != -1)]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return out


class BpeModel:
    """A SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        self.byte_id = np.zeros(256, np.int32)
        self.decoded: list[bytes] = []
        normal = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.decoded.append(bytes([value]))
            elif sp.is_control(i):
                self.decoded.append(b"")
            elif sp.is_unknown(i):
                self.decoded.append(" ⁇ ".encode())
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} reaches over a word boundary")
                normal[piece] = i
                self.decoded.append(piece.replace(SPACE, " ").encode())
        # Symbols: piece ids; then single characters that only longer pieces hold.
        self.symbol = {p: i for p, i in normal.items() if len(p) == 1}
        for piece in normal:
            for c in piece:
                self.symbol.setdefault(c, size + len(self.symbol))
        known = normal | {c: i for c, i in self.symbol.items() if c not in normal}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = known.get(piece[:k]), known.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = _Pairs(pairs)
        # The order of merging: highest score first.
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.size = size
        self.top = size + len(self.symbol) + 1
        self.codes = np.full(0x110000, -1, np.int32)
        for c, i in self.symbol.items():
            self.codes[ord(c)] = i
        self.points = np.zeros(len(self.symbol) + 1, np.int64)
        for c, i in self.symbol.items():
            if i >= size:
                self.points[i - size] = ord(c)
        self.decimal = np.array([str(i).encode() for i in range(size)], object)
        self.plain = np.array(self.decoded, object)
        # A piece that, next to its own left half, makes a piece of better rank: merged one at a time.
        self.unsafe = np.zeros(size, bool)
        for (a, _), m in pairs.items():
            z = pairs.get((m, a))
            if z is not None and self.rank[z] < self.rank[m]:
                self.unsafe[m] = True
        self.keep_ids = False
        self.cache: dict[bytes, tuple] = {}
        self.cached = 0

    def merge(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of every segment, flat, and their offsets."""
        done_s, done_seg = [], []
        seg = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        s = symbols.astype(np.int64)
        while len(s):
            same = seg[1:] == seg[:-1]
            made = np.full(len(s) - 1, -1, np.int64)
            at = np.flatnonzero(same)
            made[at] = self.pairs.find(s[at], s[at + 1])
            found = np.flatnonzero(made >= 0)
            none = np.iinfo(np.int64).max
            least = np.full(len(offsets) - 1, none)
            np.minimum.at(least, seg[found], self.rank[made[found]])
            over = least[seg] == none
            if over.any():
                done_s.append(s[over])
                done_seg.append(seg[over])
            pick = found[self.rank[made[found]] == least[seg[found]]]
            # Leftmost first: in a run of overlapping pairs every other one merges.
            run = np.concatenate([[True], np.diff(pick) != 1]) if len(pick) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(run, np.arange(len(pick)), 0))
            pick = pick[(np.arange(len(pick)) - first) % 2 == 0]
            odd = self.unsafe[made[pick]]
            if odd.any():
                rush = np.zeros(len(offsets) - 1, bool)
                rush[seg[pick[odd]]] = True
                pick = pick[~rush[seg[pick]] | np.concatenate([[True], seg[pick[1:]] != seg[pick[:-1]]])]
            s[pick] = made[pick]
            keep = ~over
            keep[pick + 1] = False
            s, seg = s[keep], seg[keep]
        if not done_s:
            return symbols[:0], np.zeros(len(offsets), np.int64)
        s, seg = np.concatenate(done_s), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return s[order], np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=len(offsets) - 1))])

    def segments(self, found: list[bytes]) -> None:
        """Encode distinct segments into the cache: decimal ids, their number, decoded bytes, ids."""
        texts = [x.decode() for x in found]
        # A segment without marks follows a single space.
        texts = [t if t[:1] == SPACE else SPACE + t for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        code = self.codes[points]
        unknown = code < 0
        s, off = self.merge(np.where(unknown, self.top, code), np.concatenate([[0], np.cumsum(lengths)]))
        # Characters without a piece of their own stand for the pieces of their bytes.
        spare = np.flatnonzero(s >= self.size)
        if len(spare):
            chars = np.empty(len(s), np.int64)
            chars[s == self.top] = points[unknown]
            held = (s >= self.size) & (s != self.top)
            chars[held] = self.points[s[held] - self.size]
            raw = [chr(c).encode() for c in chars[spare].tolist()]
            width = np.ones(len(s), np.int64)
            width[spare] = [len(r) for r in raw]
            to = np.concatenate([[0], np.cumsum(width)])
            ids = np.repeat(s, width)
            ids[np.repeat(s >= self.size, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            s, off = ids, to[off]
        decimal, decoded = self.decimal[s].tolist(), self.plain[s].tolist()
        cuts, ids, cache = off.tolist(), s.astype(np.int32), self.cache
        for k, name in enumerate(found):
            i, j = cuts[k], cuts[k + 1]
            entry = (b" ".join(decimal[i:j]), j - i, b"".join(decoded[i:j]), ids[i:j].copy() if self.keep_ids else None)
            cache[name] = entry
            self.cached += _held(name, entry)

    def cut(self, text: bytes) -> list[bytes]:
        """The text cut at spaces: plain words where one space stands before each, else runs of marks with their word."""
        if _MARK in text:  # a mark in the text is escaped as a space is
            text = text.replace(_MARK, b" ")
        parts = text.split(b" ")
        if b"" not in parts:
            return parts
        if not text:
            return []
        # The dummy prefix is one more space in front; empty parts lengthen the run before a word.
        out, run = [], 0
        for part in parts:
            run += 1
            if part:
                out.append(part if run == 1 else _MARK * run + part)
                run = 0
        if run:
            out.append(_MARK * run)
        return out

    def encode_all(self, texts: list[bytes]) -> list[list[tuple]]:
        """The cached entries of every text's segments."""
        cuts = [self.cut(t) for t in texts]
        used = set().union(*cuts)
        if self.cached > CACHE_BYTES:  # what these texts have stays
            self.cache = {name: self.cache[name] for name in used.intersection(self.cache)}
            self.cached = sum(_held(*x) for x in self.cache.items())
        for some in _portions(used.difference(self.cache)):
            self.segments(some)
        get = self.cache.__getitem__
        return [list(map(get, c)) for c in cuts]

    def encode(self, text: str) -> list[int]:
        self.keep_ids or self.start_keeping()
        (parts,) = self.encode_all([text.encode()])
        return [i for p in parts for i in p[3].tolist()] + [self.end]

    def start_keeping(self) -> None:
        self.drop()
        self.keep_ids = True

    def drop(self) -> None:
        """Forget all segments."""
        self.cache.clear()
        self.cached = 0

    def decode(self, ids: list[int]) -> str:
        return as_text(b"".join(self.plain[ids].tolist()) if len(ids) else b"")


def _held(name: bytes, entry: tuple) -> int:
    """About the bytes that a kept segment takes."""
    return ENTRY_BYTES + len(name) + len(entry[0]) + len(entry[2]) + (0 if entry[3] is None else 150 + entry[3].nbytes)


def _portions(found: set[bytes]) -> Iterator[list[bytes]]:
    """The segments in lists of about `MERGED` bytes, or one longer segment."""
    out, size = [], 0
    for name in found:
        if out and size + len(name) > MERGED:
            yield out
            out, size = [], 0
        out.append(name)
        size += len(name)
    if out:
        yield out


def as_text(raw: bytes) -> str:
    """Decoded bytes without the dummy prefix; bytes that are not UTF-8 become U+FFFD."""
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_models: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """The model of this process."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = model(path)
    if with_ids:
        bpe.keep_ids or bpe.start_keeping()
    end = str(bpe.end).encode()
    for batch in pieces(batches, TEXT_BYTES):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        count, digest, decoded, ids = [], [], [], []
        for parts in bpe.encode_all(texts):
            count.append(sum([p[1] for p in parts]) + 1)
            digest.append(hashlib.sha256(b" ".join([p[0] for p in parts] + [end])).hexdigest())
            decoded.append(as_text(b"".join([p[2] for p in parts])))
            if with_ids:
                ids.append(np.concatenate([*[p[3] for p in parts], [bpe.end]]).astype(np.int32))
        added = {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded": pa.array(decoded, pa.string())}
        if with_ids:
            added["ids"] = pa.array(ids, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names=names)
    bpe.drop()


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """docs (text and any more columns) with n_tokens, ids_sha256, decoded and, if asked for, ids.

    ids end with the end id. An input column of one of these names is replaced.
    """
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded", "string")] + [("ids", "array<int>")] * with_ids
    schema = with_fields(docs.schema, *fields)
    names = schema.names
    return docs.mapInArrow(tidy(lambda it: _encode(it, model_path, names, with_ids)), schema)
