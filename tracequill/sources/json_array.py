"""One large JSON array read by many tasks.

A file is cut into ranges of bytes. Where a range begins, three things are unknown: whether that is inside
a string, whether a backslash is pending, and how deep the nesting is. So ranges are read twice:

1. Each is summed up as a function: for every state it may begin in, the state it ends in and by how much
   the depth changes. A summary is a few numbers.
2. The functions of a file are composed in order, which gives each range its true state and depth.
3. Each range then yields the elements that begin in it, and reads on past its end for the last one.

No task holds more than a block of a range and one element. Elements come out as text, with the offset
where they begin; `elements_as` parses them by a schema inside Spark. Paths are those that pyarrow.fs
understands (file, hdfs, s3, gs, abfs).

Defined cases: a top-level object is one element; blank elements (an empty array, a trailing comma) are
none; an element cut off at the end of the file is none; a byte order mark is passed over; arrays that
follow one another are read in turn, and so are objects; an empty or blank file has no elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range, and of what a task looks at in one step.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: The states a range can begin in: outside of strings, inside of one, inside of one with a backslash pending.
PLAIN, STRING, ESCAPE = range(3)
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[list(b"[]{},")] = True
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_RANGES = "path string, size long, k long, start long, stop long"
_SUMMARIES = _RANGES + ", ends array<int>, depths array<long>, first int"
_STARTS = _RANGES + ", state int, depth long, whole boolean"
_ELEMENTS = "path string, offset long, element string"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def opened(path: str):
    """An open file of pyarrow's, by a path as Spark prints it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    fs, where = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(where)


def blocks(file, start: int, stop: int, size: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of a range, a block at a time."""
    file.seek(start)
    while start < stop:
        data = file.read(min(size or BLOCK_BYTES, stop - start))
        if not data:
            return
        yield start, np.frombuffer(data, np.uint8)
        start += len(data)


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside of strings, steps in depth there, the state behind the bytes)."""
    slashes = np.flatnonzero(data == _BACKSLASH)
    pending = state == ESCAPE
    escaped = np.zeros(0, np.int64)
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        begin, run = slashes[first], np.diff(first, append=len(slashes))
        odd = (run - ((begin == 0) & pending)) % 2 == 1
        escaped = (begin + run)[odd]
        if pending and begin[0] != 0:
            escaped = np.concatenate([[0], escaped])
        pending = len(escaped) > 0 and escaped[-1] == len(data)
    elif pending:
        escaped, pending = np.zeros(1, np.int64), len(data) == 0
    quotes = np.flatnonzero(data == _QUOTE)
    quotes = quotes[~np.isin(quotes, escaped)]
    inside = int(state != PLAIN)
    spots = np.flatnonzero(_STRUCTURE[data])
    spots = spots[(np.searchsorted(quotes, spots) + inside) % 2 == 0]
    ends = STRING if (len(quotes) + inside) % 2 else PLAIN
    return spots, _STEP[data[spots]].astype(np.int64), ESCAPE if pending else ends


def summary(file, start: int, stop: int) -> tuple[list[int], list[int], int]:
    """(state behind the range, change in depth) for each state it may begin in, and its first byte that is not blank."""
    states, depths, first = [PLAIN, STRING, ESCAPE], [0, 0, 0], -1
    for _, data in blocks(file, start, stop):
        known = {s: structure(data, s) for s in set(states)}
        depths = [d + int(known[s][1].sum()) for s, d in zip(states, depths, strict=True)]
        states = [known[s][2] for s in states]
        if first < 0:
            # The mark's bytes, which a cut may part, begin no JSON.
            text = data.tobytes().lstrip(b" \t\r\n\xef\xbb\xbf")
            first = text[0] if text else -1
    return states, depths, first


def elements(file, start: int, stop: int, size: int, state: int, depth: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the elements that begin in a range; whole: the document is one element itself."""
    parts: list[bytes] = []  # of an element that has begun
    begun = -1

    def closed(rest: bytes) -> Iterator[tuple[int, bytes]]:
        text = b"".join([*parts, rest])
        lead = len(text) - len(text.lstrip())
        if text.strip():
            yield begun + lead, text.strip()

    for at, data in blocks(file, start, size):
        if at >= stop and begun < 0:
            return
        spots, steps, after = structure(data, state)
        depths = depth + np.cumsum(steps)
        # A boundary opens the level, parts two elements on it, or closes it.
        if whole:
            edge = (depths == 0) | ((depths == 1) & (steps == 1))
        else:
            edge = ((depths == 1) & (data[spots] == _COMMA)) | ((depths == 1) & (steps == 1) & (depths - steps == 0)) | ((depths == 0) & (steps == -1))
        raw, left = data.tobytes(), 0
        for i in np.flatnonzero(edge):
            spot, closing = int(spots[i]), steps[i] == -1
            if begun >= 0:
                yield from closed(raw[left : spot + (1 if whole else 0)])
                parts, begun = [], -1
            if closing and depths[i] == 0:
                continue
            if at + spot >= stop:
                return
            begun, left = at + spot + (0 if whole else 1), spot + (0 if whole else 1)
        if begun >= 0:
            parts.append(raw[left:])
        depth, state = (int(depths[-1]) if len(depths) else depth), after


def _compose(key, table):
    """The state and depth in which each range of one file begins: a few numbers a range."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    first = next((r["first"] for r in rows if r["first"] >= 0), -1)
    state, depth, out = PLAIN, 0, []
    for r in rows:
        if first in (ord("["), ord("{")):
            out.append({c: r[c] for c in ("path", "size", "k", "start", "stop")} | {"state": state, "depth": depth, "whole": first == ord("{")})
        state, depth = r["ends"][state], depth + r["depths"][state]
    if rows and first not in (-1, *b"[{"):
        raise ValueError(f"{rows[0]['path']}: neither an array nor an object")
    return pa.Table.from_pylist(out, _arrow(_STARTS))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with opened(r["path"]) as file:
                ends, depths, first = summary(file, r["start"], r["stop"])
            yield pa.RecordBatch.from_pylist([r | {"ends": ends, "depths": depths, "first": first}], _arrow(_SUMMARIES))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _arrow(_ELEMENTS)
    for batch in batches:
        for r in batch.to_pylist():
            held, size = [], 0
            with opened(r["path"]) as file:
                for offset, text in elements(file, r["start"], r["stop"], r["size"], r["state"], r["depth"], r["whole"]):
                    held.append({"path": r["path"], "offset": offset, "element": text.decode("utf-8", "replace")})
                    size += len(text)
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, kind)


def read_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, element) of the elements of JSON arrays, one array a file, ranges dealt over tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    step = F.lit(range_bytes)
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("k"))
    cut = cut.select("path", "size", "k", (F.col("k") * step).alias("start"), F.least("size", (F.col("k") + 1) * step).alias("stop"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    summed = cut.repartition(tasks).mapInArrow(_summaries, _SUMMARIES)
    known = summed.groupBy("path").applyInArrow(_compose, _STARTS)
    return known.repartition(tasks).mapInArrow(_elements, _ELEMENTS)


def elements_as(rows: DataFrame, schema: str | T.StructType) -> DataFrame:
    """read_elements() with the fields of schema; elements that are no objects of it have nulls."""
    return rows.select("path", "offset", F.from_json("element", schema).alias("e")).select("path", "offset", "e.*")


def write_arrays(rows: DataFrame, folder: str, value: Column) -> None:
    """Writes rows as JSON arrays, one a partition: value is an element's JSON."""

    def bracketed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        first = True
        for batch in batches:
            texts = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("" if first and i == 0 else ",") + t for i, t in enumerate(texts)], pa.string())], names=["value"])
            first = first and not texts
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows.select(value.alias("value")).mapInArrow(bracketed, "value string").write.text(folder)
