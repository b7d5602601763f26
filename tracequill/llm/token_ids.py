"""Token ids in files: Re-Pair grammar compression per shard, with random access to documents.

Documents are cut into ranges of doc_id and, within a range, into shards of about `SHARD_IDS` ids.
In a shard, rounds count all neighbouring pairs of symbols inside documents and replace the most
frequent ones by new nonterminals, from the left and all at once, until no pair is frequent; rules
that nothing uses are dropped. The file keeps the rules, the number of ids each expands to, where each
document starts among the symbols, and the symbols in blocks of their own: a document decodes from
the blocks that hold its symbols alone.

Shards are rows of Parquet files that Spark writes to the shared folder, so any store will do and
a lost task's output is written again. A start offset is the sum over earlier ranges, earlier
shards of the range and earlier documents of the shard.

Defined cases: a null or empty text is the end id alone; equal ids go by a hash of the text, null
ids first; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, partitions, tidy
from .packing import pack, unpack
from .words import flatten, pieces

#: Ids per shard, replacements per round, and the least frequency of a replaced pair.
SHARD_IDS, PAIRS, FREQUENT = 1_500_000, 8192, 16
#: Symbols in a block.
BLOCK = 1 << 16
#: Buckets that pairs are counted in by hash: the high bits of a product.
BUCKETS, MIXER, SHIFT = 1 << 20, np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
#: Distinct pieces of words whose ids a worker process keeps between batches, and those encoded in one call.
CACHE, LINES = 800_000, 1000
SHARDS = "range int, shard int, n_ids long, n_docs int, payload binary"


def compress(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules): rule k, a pair of symbols, is the symbol base + k."""
    base = int(ids.max()) + 1 if len(ids) else 1
    s = ids.astype(np.int64)
    last = np.zeros(len(s), bool)
    last[np.cumsum(lengths) - 1] = True
    rules: list[np.ndarray] = []
    top = base
    # Where a pair begins that may be frequent: a rare pair never gets frequent, so later rounds look at new and frequent ones.
    live = ~last
    while len(s) > 1:
        inner = np.flatnonzero(live[:-1])
        key = (s[inner] << 31) | s[inner + 1]
        # Pairs are counted by hash first: what falls in a rare bucket is rare.
        bucket = ((key.view(np.uint64) * MIXER) >> SHIFT).view(np.int64)
        some = np.flatnonzero((np.bincount(bucket, minlength=BUCKETS) >= FREQUENT)[bucket])
        inner, key, bucket = inner[some], key[some], bucket[some]
        found, count = np.unique(key, return_counts=True)
        often = np.flatnonzero(count >= FREQUENT)
        if len(often) > PAIRS:
            often = often[np.argpartition(-count[often], PAIRS - 1)[:PAIRS]]
        if not len(often):
            break
        # One pair a bucket, the most frequent; others of the bucket wait for the next round.
        often = often[np.argsort(count[often], kind="stable")]
        slots = np.full(BUCKETS, -1, np.int64)
        places = ((found[often].view(np.uint64) * MIXER) >> SHIFT).view(np.int64)
        slots[places] = np.arange(len(often))
        chosen = found[often]
        slot = slots[bucket]
        hit = np.flatnonzero((slot >= 0) & (key == chosen[slot]))
        at, slot = inner[hit], slot[hit]
        run = np.concatenate([[True], np.diff(at) != 1])
        number = np.arange(len(at))
        take = np.flatnonzero(((number - np.maximum.accumulate(np.where(run, number, 0))) & 1) == 0)
        at, slot = at[take], slot[take]
        rules.append(np.stack([chosen >> 31, chosen & ((1 << 31) - 1)], 1))
        s[at] = top + slot
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        live[:] = False
        live[inner] = True
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        live &= ~last
        left = np.flatnonzero(keep)
        s, last, live, top = s[left], last[left], live[left], top + len(chosen)
    per = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    s, found = pruned(s, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), base)
    return s, per, found


def pruned(symbols: np.ndarray, rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols and rules without the rules that nothing uses; a rule only uses symbols before its own."""
    uses = np.bincount(symbols, minlength=base + len(rules))
    uses += np.bincount(rules.ravel(), minlength=base + len(rules))
    for k in range(len(rules) - 1, -1, -1):
        if not uses[base + k]:
            uses[rules[k, 0]] -= 1
            uses[rules[k, 1]] -= 1
    kept = uses[base:] > 0
    new = np.concatenate([np.arange(base), base + np.cumsum(kept) - 1])
    return new[symbols], new[rules[kept]]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    s = symbols
    while len(s):
        high = s >= base
        if not high.any():
            break
        width = np.where(high, 2, 1)
        end = np.cumsum(width)
        out = np.empty(int(end[-1]), np.int64)
        out[end - width] = np.where(high, rules[np.where(high, s - base, 0), 0], s) if len(rules) else s
        out[end[high] - 1] = rules[s[high] - base, 1]
        s = out
    return s


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    end = np.cumsum(size)
    return values[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def rule_sizes(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to."""
    size = [1] * base + [0] * len(rules)
    for k, (a, b) in enumerate(rules.tolist(), base):
        size[k] = size[a] + size[b]
    return np.array(size[base:], np.int64)


class Shard:
    """A shard file: whole decoding, and single documents from the blocks that hold their symbols."""

    def __init__(self, payload: bytes) -> None:
        (head,) = struct.unpack_from("<Q", payload)
        left, right, rule_ids, per, docs, missing, base, blocks = unpack(payload[8 : 8 + head])
        self.payload, self.rules, self.base = payload, np.stack([left, right], 1).astype(np.int64), int(base[0])
        self.rule_ids = rule_ids.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(per.astype(np.int64))])
        self.docs = [None if m else d for d, m in zip(docs.view(np.int64).tolist(), missing.tolist(), strict=True)]
        self.places = 8 + head + np.concatenate([[0], np.cumsum(blocks.astype(np.int64))])
        self.opened = 0
        # All rules written out one after the other, behind the ids themselves.
        self.table = np.concatenate([np.arange(self.base), expand(np.arange(self.base, self.base + len(self.rules)), self.rules, self.base)])
        self.size = np.concatenate([np.ones(self.base, np.int64), self.rule_ids])
        self.start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.rule_ids) - self.rule_ids])

    def symbols(self, first: int, last: int) -> np.ndarray:
        """Symbols from one place to another."""
        i, j = first // BLOCK, -(-last // BLOCK)
        self.opened += j - i
        found = [unpack(self.payload[self.places[k] : self.places[k + 1]])[0].astype(np.int64) for k in range(i, j)]
        return np.concatenate(found)[first - i * BLOCK : last - i * BLOCK] if found else np.zeros(0, np.int64)

    def decoded(self, symbols: np.ndarray) -> np.ndarray:
        return ragged(self.table, self.start[symbols], self.size[symbols])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and how many each has."""
        symbols = self.symbols(0, int(self.offsets[-1]))
        sums = np.concatenate([[0], np.cumsum(self.size[symbols])])
        return self.decoded(symbols), np.diff(sums[self.offsets])

    def document(self, k: int) -> np.ndarray:
        return self.decoded(self.symbols(int(self.offsets[k]), int(self.offsets[k + 1])))

    @staticmethod
    def write(docs: list, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        symbols, per, rules = compress(ids, lengths)
        base = int(ids.max()) + 1
        known = np.array([d or 0 for d in docs], np.int64)
        missing = np.array([d is None for d in docs], np.uint64)
        blocks = [pack(symbols[i : i + BLOCK]) for i in range(0, len(symbols), BLOCK)]
        head = pack(rules[:, 0], rules[:, 1], rule_sizes(rules, base), per, known.view(np.uint64), missing, np.array([base]), np.array([len(b) for b in blocks], np.int64))
        return b"".join([struct.pack("<Q", len(head)), head, *blocks])


class Coder:
    """A tokenizer that drops white space and never joins over it, run over distinct words and their pieces.

    Words of plain Latin letters, digits and signs are lower-cased and cut as the tokenizer's
    pre-tokenizer does, and the library encodes the distinct pieces with the tokenizer's model, many
    at once, so that a word and its forms with a capital or a full stop share them; other words, and
    any that may hold a special token, go to the tokenizer whole. A process keeps the ids of pieces.
    """

    #: Characters for which lower-casing, composing and letter classes are the same everywhere.
    #: No `<`: it may begin a special token.
    PLAIN = "^[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*$"
    #: Bytes of lines of such words in lower case: signs 0, letters 1, and 2 for pieces of one byte: digits, a line's end.
    KINDS = np.array([1 if c >= 128 or chr(c).islower() else 2 if chr(c).isdigit() or c == 10 else 0 for c in range(256)], np.uint8)

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for lines of pieces: a line's end, in the byte-level alphabet, is a token of its own.
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = Sequence([ByteLevel(add_prefix_space=False, use_regex=False), Split("\u010a", "isolated")])
        (self.mark,) = self.lines.encode("\n").ids
        self.forget()

    def forget(self) -> None:
        """Keeps only the line's end, which is place 0 and has no ids."""
        self.known, self.ids, self.size = {"\n": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _keep(self, found: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(found, range(len(self.known), len(self.known) + len(found)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def _learn(self, parts: list[str], words: list[str]) -> None:
        """Encodes and keeps what is new: pieces some at a time, and whole words."""
        lines = ["\n".join([*parts[i : i + LINES], ""]) for i in range(0, len(parts), LINES)]
        got = [np.array(e.ids, "<u4") for e in self.lines.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *got])
        inner = ids != self.mark
        self._keep(parts, ids[inner], np.diff(np.flatnonzero(~inner), prepend=-1) - 1)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._keep(words, np.array([i for ids in got for i in ids], "<u4"), np.array([len(ids) for ids in got], np.int64))

    def pieces(self, words: pa.Array) -> pa.Array:
        """Pieces of plain words, with a line's end behind each word."""
        lines, _ = flatten(pc.binary_join_element_wise(pc.utf8_lower(words), "", "\n"))
        kind = self.KINDS[lines]
        first = kind == 2
        first[1:] |= kind[1:] != kind[:-1]
        first[:1] = True
        # 's 't 'm 'd 're 've 'll, where no other sign is before them, are pieces; what follows them begins another.
        quote = np.flatnonzero(first & (lines == ord("'")))
        a, b = lines[quote + 1], lines[np.minimum(quote + 2, len(lines) - 1)]
        one = np.isin(a, list(b"stmd"))
        two = (np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        first[quote[one | two] + 1] = False
        first[quote[one] + 2] = first[quote[two] + 3] = True
        starts = np.flatnonzero(first)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(lines)).astype(np.int32)), pa.py_buffer(lines))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after the other, and how many each text has."""
        if len(self.known) > CACHE:
            self.forget()
        runs = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, self.PLAIN)
        other = words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        parts = self.pieces(words.filter(plain)).dictionary_encode()
        n = len(parts.dictionary)
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist() + other
        places = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        places[new] = np.arange(len(self.known), len(self.known) + len(new))
        fresh = [names[k] for k in new.tolist()]
        cut = int(np.searchsorted(new, n))
        self._learn(fresh[:cut], fresh[cut:])
        # One line for each distinct word: plain ones first, then the others.
        whole = places[n:]
        at = np.concatenate([places[parts.indices.to_numpy()], np.stack([whole, np.zeros_like(whole)], 1).ravel()])
        size = self.size[at]
        ids = ragged(self.ids, (np.cumsum(self.size) - self.size)[at], size)
        end = np.cumsum(size)[at == 0]
        size = np.diff(end, prepend=0)
        # Those lines' ids for the words as they come in the texts.
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        line = np.empty_like(order)
        line[order] = np.arange(len(order))
        line = line[coded.indices.to_numpy()]
        ids = ragged(ids, (end - size)[line], size[line])
        sums = np.concatenate([[0], np.cumsum(size[line])])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())])])


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_texts(texts: list[bytes | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    ids, lengths = coder(path).encode(pa.array(texts, pa.binary()))
    ends = np.cumsum(lengths)
    return [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _write(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    docs: list = []
    data: list[tuple[np.ndarray, np.ndarray]] = []
    size = shard = 0
    place = 0

    def flush():
        ids, lengths = (np.concatenate(x) for x in zip(*data, strict=True))
        row = [[place], [shard], [len(ids)], [len(docs)], [Shard.write(docs, ids, lengths)]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["range", "shard", "n_ids", "n_docs", "payload"])

    for batch in pieces(batches):
        place = batch.column("range")[0].as_py()
        ids, lengths = own.encode(batch.column("text"))
        ids, lengths = np.insert(ids, np.cumsum(lengths), end), lengths + 1
        sums = np.concatenate([[0], np.cumsum(lengths)])
        known = batch.column("doc_id").to_pylist()
        i = 0
        while i < len(known):
            # Up to the document that fills the shard.
            j = min(len(known), int(np.searchsorted(sums, sums[i] + SHARD_IDS - size)))
            docs += known[i:j]
            data.append((ids[sums[i] : sums[j]], lengths[i:j]))
            size += int(sums[j] - sums[i])
            i = j
            if size >= SHARD_IDS:
                yield flush()
                docs, data, size, shard = [], [], 0, shard + 1
    if docs:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("payload")[i].as_py())
            ids, lengths = shard.all()
            ids = ids.astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("range", "shard")]
                + [pa.array(shard.docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["range", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_ids(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> str:
    """Writes the ids of docs (doc_id, text) as shard files; returns their folder in the shared one."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "th").sortWithinPartitions("doc_id", "th")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("range"))
    rows.mapInArrow(tidy(lambda it: _write(it, tokenizer, end)), SHARDS).write.parquet(folder)
    return folder


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from shard files."""
    shards = spark.read.parquet(folder)
    size = shards.select("range", "shard", "n_ids")
    totals = size.groupBy("range").agg(F.sum("n_ids").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("range", before.alias("base"))
    earlier = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("own", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(totals, "range")
    size = size.select("range", "shard", (F.col("base") + F.col("own")).alias("base"))
    rows = shards.select("range", "shard", "payload").mapInArrow(_read, "range int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = rows.join(size, ["range", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
