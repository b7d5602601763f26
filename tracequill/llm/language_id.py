"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary: whole labelled texts, up to `DICT_BYTES`. A text
belongs to the language whose dictionary compresses it smallest. A narrow margin between the
smallest and the next is measured again at a higher level; a tie there is a rejection (`rejected`),
the best guess staying in lang_pred. Texts and dictionaries are lower-cased and reduced to letters
and single spaces first. A text over `PIECE` bytes is compressed in pieces of that size at most, each
with the fresh dictionary, and the sizes are summed: zstandard drops a dictionary once the input is
past its window.

The sample is bounded: at most `SAMPLE_DOCS` texts a language, those first in the order of a hash
of doc_id among texts of 200 to 16,000 characters (others only where these run out). Everything
else covers all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; equal
sizes go to the language with the most labelled texts; without any labelled text all are `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, with_fields
from .words import pieces

SAMPLE_DOCS, DICT_BYTES = 100, 120_000
#: Bytes compressed at a time, and the least window: twice as much (small dictionaries would get less).
PIECE, WINDOW_LOG = 1 << 16, 17
#: The level of the first measure and of the second, for margins under `NARROW` bytes.
LEVEL, FINE_LEVEL, NARROW = 6, 19, 3
#: Bytes by which the second smallest must exceed the smallest for a text to be accepted.
MARGIN = 1
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def reduced(text: str) -> bytes:
    """Lower-cased letters (and other bytes over 127), all else one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


class Classifier:
    """Dictionaries by language; made from plain bytes in every process that uses it."""

    def __init__(self, samples: dict[str, bytes], rows: dict[str, int] | None = None) -> None:
        counts = rows or {}
        self.samples = dict(sorted(samples.items(), key=lambda x: (-counts.get(x[0], 0), x[0])))
        self.ready = None

    def __getstate__(self) -> dict:
        return {"samples": self.samples, "ready": None}

    def _coders(self) -> list[tuple]:
        """(language, coder, fine coder)."""
        if self.ready is None:
            self.ready = [(lang, *(_coder(data, level) for level in (LEVEL, FINE_LEVEL))) for lang, data in self.samples.items()]
        return self.ready

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        coders = self._coders()
        if text is None or not coders or not has_letter(text):
            return "und", 0.0, True
        data = reduced(text)
        sizes = [_size(c, data) for _, c, _ in coders]
        first = sorted(sizes)
        if len(first) > 1 and first[1] - first[0] < NARROW:
            sizes = [_size(c, data) for _, _, c in coders]
        best = min(sizes)
        at = sizes.index(best)
        score = 1.0 / sum([2.0 ** max(-60, best - s) for s in sizes])
        second = min(sizes[:at] + sizes[at + 1 :], default=best + MARGIN)
        return coders[at][0], score, second - best < MARGIN


def _size(coder: zstandard.ZstdCompressor, data: bytes) -> int:
    return sum(len(coder.compress(data[i : i + PIECE])) for i in range(0, max(1, len(data)), PIECE))


def _coder(data: bytes, level: int) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    like = {"source_size": 4000, "dict_size": len(data), "write_content_size": 0}
    window_log = max(WINDOW_LOG, zstandard.ZstdCompressionParameters.from_level(level, **like).window_log)
    how = zstandard.ZstdCompressionParameters.from_level(level, window_log=window_log, **like)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def train(labelled: DataFrame) -> Classifier:
    """A classifier from labelled (doc_id, text, lang): all rows given are candidates for the sample."""
    rows = labelled.filter("text is not null and lang is not null")
    middling = F.when(F.length("text").between(200, 16000), 0).otherwise(1)
    slim = rows.select("lang", "doc_id", middling.alias("odd"), F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("odd", "h", "doc_id")
    chosen = slim.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_DOCS).select("lang", "doc_id", "r").collect()
    if not chosen:
        return Classifier({})
    place = {(c.lang, c.doc_id): c.r for c in chosen}
    texts = rows.filter(F.col("doc_id").isin([c.doc_id for c in chosen])).select("lang", "doc_id", "text").collect()
    texts = sorted((t for t in texts if (t.lang, t.doc_id) in place), key=lambda t: (t.lang, place[t.lang, t.doc_id], t.text))
    samples: dict[str, bytes] = {}
    for t in texts:
        own = samples.get(t.lang, b"")
        data = reduced(t.text)
        if not own or len(own) + len(data) <= DICT_BYTES:
            samples[t.lang] = own + data + b"\n"
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    return Classifier(samples, counts)


def _predict(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    classifier = shared.value
    for batch in pieces(batches):
        got = [classifier.classify(t) for t in batch.column("text").to_pylist()]
        added = {
            "lang_pred": pa.array([g[0] for g in got], pa.string()),
            "score": pa.array([g[1] for g in got], pa.float64()),
            "rejected": pa.array([g[2] for g in got], pa.bool_()),
        }
        yield pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names=names)


def predict(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs (text and any more columns) with lang_pred, score and rejected, replacing columns so named."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = with_fields(docs.schema, ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))
    names = schema.names
    return docs.mapInArrow(tidy(lambda it: _predict(it, shared, names)), schema)
