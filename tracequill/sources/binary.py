"""The binary trace format: a header, a table of strings, and a record of varying length per event."""

from __future__ import annotations

import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..schema import EVENT_TYPES

# Magic and version, size of the header, and what the flags of a record say it has.
MAGIC, VERSION, HEADER = b"NDV", 1, 16
DURATION, OPERATION, ERROR, CONTEXT = 1, 2, 4, 8
FIELDS = "pos long, channel string, event_type string, ts_ms double, duration_ms double, operation_id string, error_message string, context_json string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def encode(table: pa.Table) -> bytes:
    """Events, in order, as one binary trace; each string is written once, an error as `name: message`."""
    strings: dict[str, int] = {}
    records = []
    put = lambda text: strings.setdefault(text, len(strings)) if text else 0
    for e in table.to_pylist():
        channel, operation = put(e["channel"]), put(e["operation_id"])
        context = e["context_json"] if e["context_json"] not in (None, "", "{}") else None
        message = e["error_message"]
        error = f"{e.get('error_name') or 'Error'}: {message}" if message is not None else None
        flags, tail = 0, b""
        if context:
            put(context)
        if error:
            put(error)
        if e["duration_ms"] is not None:
            flags, tail = flags | DURATION, tail + struct.pack("<d", e["duration_ms"])
        for flag, text in ((OPERATION, operation if e["operation_id"] is not None else None), (ERROR, put(error) if error else None), (CONTEXT, put(context) if context else None)):
            if text is not None:
                flags, tail = flags | flag, tail + struct.pack("<I", text)
        records.append(struct.pack("<BIdB", EVENT_TYPES.index(e["event_type"]), channel, e["ts_ms"], flags) + tail)
    texts = [s.encode() for s in strings]
    head = MAGIC + bytes([VERSION, 1, 0, 0, 0]) + struct.pack("<II", len(texts), len(records))
    return b"".join([head, *(struct.pack("<I", len(t)) + t for t in texts), *records])


def decode(data: bytes) -> list[tuple]:
    """Rows of FIELDS of one binary trace; a foreign, newer or cut file raises an error."""
    if len(data) < HEADER or data[:3] != MAGIC:
        raise ValueError("not a binary trace")
    if data[3] != VERSION:
        raise ValueError(f"binary trace of version {data[3]}")
    n_strings, n_events = struct.unpack_from("<II", data, 8)
    at, strings, rows = HEADER, [], []
    try:
        for _ in range(n_strings):
            (size,) = struct.unpack_from("<I", data, at)
            if at + 4 + size > len(data):
                raise ValueError("binary trace is cut short")
            strings.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
        for pos in range(n_events):
            kind, channel, ts, flags = struct.unpack_from("<BIdB", data, at)
            at += 14
            duration = None
            if flags & DURATION:
                (duration,) = struct.unpack_from("<d", data, at)
                at += 8
            texts = []
            for flag in (OPERATION, ERROR, CONTEXT):
                texts.append(None)
                if flags & flag:
                    texts[-1] = strings[struct.unpack_from("<I", data, at)[0]]
                    at += 4
            rows.append((pos, strings[channel], EVENT_TYPES[min(kind, len(EVENT_TYPES) - 1)], ts, duration, *texts))
    except (struct.error, IndexError) as e:
        raise ValueError("binary trace is cut short") from e
    return rows


def encoded(events: DataFrame, by: str) -> DataFrame:
    """(by, content): one binary trace per value of `by`, its events by seq."""
    kind = events.schema[by].dataType.simpleString()
    wanted = [c for c in ("seq", "channel", "event_type", "ts_ms", "duration_ms", "operation_id", "error_message", "error_name", "context_json") if c in events.columns]

    def run(table: pa.Table) -> pa.Table:
        return pa.table({by: table.column(by)[:1], "content": pa.array([encode(table.sort_by("seq"))], pa.binary())})

    return events.select(by, *wanted).groupBy(by).applyInArrow(run, f"{by} {kind}, content binary")


def decoded(contents: DataFrame, name: str) -> DataFrame:
    """(name, content) -> the events of each binary trace, with their place in it."""
    kind = contents.schema[name].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(name), batch.column("content").to_pylist(), strict=True):
                columns = list(zip(*decode(data), strict=True)) or [()] * len(_NAMES)
                types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(arrays[0]), batch.schema.field(name).type), *arrays], names=[name, *_NAMES])

    return contents.select(name, "content").mapInArrow(run, f"{name} {kind}, {FIELDS}")


def read_ndv(spark: SparkSession, path: str) -> DataFrame:
    """Events of binary trace files: a task reads whole files."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), "file")


#: File name of a null key; no quoted text looks like it.
_NULL = "%null"


def _file(key: str | None) -> str:
    """A file name for a key. Names that begin with a dot or an underscore are hidden from Spark, so these are quoted too."""
    name = _NULL if key is None else quote_plus(key)
    return (f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") else name) + ".ndv"


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None
    names: list[str]


class _NdvWriter(DataSourceArrowWriter):
    """Each attempt of a task fills a hidden folder of its own; only those that Spark commits are moved into place.

    The hidden folder of the whole job is made here, not by tasks: what is still running after an abort has no
    place left to write to.
    """

    def __init__(self, uri: str):
        self.uri, self.staging = uri, f".staging-{uuid.uuid4().hex}"
        where, root = self._at()
        where.create_dir(f"{root}/{self.staging}", recursive=True)

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, iterator):
        where, root = self._at()
        mine, names = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not names:
                    where.create_dir(mine, recursive=False)
                names.append(_file(key))
                with where.open_output_stream(f"{mine}/{names[-1]}") as out:
                    out.write(data)
        return _Written(mine if names else None, names)

    def commit(self, messages):
        where, root = self._at()
        moves = [(f"{m.folder}/{name}", f"{root}/{name}") for m in messages if m is not None for name in m.names]
        with ThreadPoolExecutor(16) as pool:  # renames only
            list(pool.map(lambda x: where.move(*x), moves))
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        where, root = self._at()
        if where.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.staging}")


class NdvSink(DataSource):
    """Format `tracequill_ndv`: rows (name string, content binary) as files <name>.ndv of the folder in `uri`."""

    @classmethod
    def name(cls) -> str:
        return "tracequill_ndv"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _NdvWriter:
        return _NdvWriter(self.options["uri"])


def write_ndv(events: DataFrame, by: str, folder: str) -> DataFrame:
    """Writes `folder`/<value of by>.ndv, once the job is done, and returns (by, bytes) of the folder's files.

    A path without a scheme lies on the cluster's default file system. A file of the same name is replaced; a
    job that fails leaves none behind.
    """
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString().replace("file:/", "file:///", 1) if system.getScheme() == "file" else system.makeQualified(path).toString()
    spark.dataSource.register(NdvSink)
    rows = encoded(events, by).select(F.col(by).cast("string").alias("name"), "content")
    rows.write.format("tracequill_ndv").option("uri", uri).mode("append").save()
    name = F.regexp_extract("path", r"([^/]*)\.ndv$", 1)
    key = F.when(name != _NULL, F.url_decode(name)).cast(events.schema[by].dataType)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ndv").load(uri).select(key.alias(by), F.col("length").alias("bytes"))
