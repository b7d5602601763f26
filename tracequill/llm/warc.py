"""Web archives in ZIP packages: records written from pages, and read back by byte ranges.

A package holds WARC files as stored (not deflated) members under `archive/`, each record its own gzip
member, and CDXJ indexes under `indexes/` that give every record's offset and length. The reader never
unpacks: it reads the end of the package, the ZIP64 and central directories and the members' local
headers, cuts the indexes into pieces, deals these to tasks, and fetches the records of each piece as
ranges of the package. A package without an index has its archive members scanned, a task each.

Packages are real files at a path that pyarrow.fs understands (file, hdfs, s3, gs, abfs). A task writes
under a name of its own and returns it; only names that reach the manifest, which Spark commits, exist
for readers, so a lost attempt's file is never read.

Payloads that occur more than once are written once: of those with equal bytes and MIN_REVISIT bytes
or more, the page with the smallest id holds the payload and the others are revisit records of it.

Defined cases: null html is an empty payload; rows of the smallest id all are responses; a null id comes
last: it revisits a page with an id, and has no id to be revisited; a null url has no target; control
characters, blanks and others beyond ASCII in a url are percent-encoded; an empty table gives no
packages and no records; repeated rows give a record each; other columns are not read. On reading, a
deflated archive member or a broken directory is an error that names the package.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, forget, partitions, saved, tidy

#: Payloads under so many bytes are always written in full.
MIN_REVISIT = 100
#: Bytes of a package's records, of an index piece, and of a range fetched at once.
PACKAGE_BYTES, PIECE_BYTES, FETCH_BYTES = 256 << 20, 128 << 10, 4 << 20
#: Revisits that may be broadcast: some 10 MB. More are joined by a shuffle.
BROADCAST_ROWS = 100_000
MANIFEST = "path string, n_records long, n_bytes long"
PIECES = "path string, member string, start long, stop long, bound long, first boolean, archives array<struct<name string, start long, size long>>"
RECORDS = "path string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, digest string, content_length long, payload binary"
#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
_PRINTABLE = "".join(map(chr, range(33, 127)))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# ---- writing


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=_PRINTABLE)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """One package, written front to back: records, then the index of their offsets."""

    NAME = "data.warc.gz"

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.fs, self.where = opened(self.path)
        self.fs.create_dir(self.where.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.where)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(self._entry(f"archive/{self.NAME}"), "w", force_zip64=True)
        self.size, self.index = 0, []

    @staticmethod
    def _entry(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, url: str | None, record: bytes, digest: str, date: str) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = press.compress(record) + press.flush()
        self.member.write(data)
        line = {"url": url, "digest": f"sha256:{digest}", "offset": str(self.size), "length": str(len(data)), "filename": self.NAME}
        stamp = "".join(c for c in date if c.isdigit())
        self.index.append(f"{quote(url or '-', safe=_PRINTABLE)} {stamp} {json.dumps(line)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(self._entry("indexes/index.cdxj"), "".join(self.index))
        self.zip.writestr(self._entry("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": f"archive/{self.NAME}"}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()
        self.file.close()
        return self.path, len(self.index), self.size

    def abandon(self) -> None:
        """After an error: nothing of the attempt stays."""
        try:
            self.member.close()
            self.zip.close()
            self.file.close()
        finally:
            self.fs.delete_file(self.where)


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, package_bytes: int) -> Iterator[pa.RecordBatch]:
    out = None
    done: list[tuple[str, int, int]] = []
    try:
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                out = out or PackageWriter(folder)
                out.add(url, record_bytes(page, url, html or b"", digest, refers_to, date), digest, date)
                if out.size >= package_bytes:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
            out = None
    except BaseException:
        if out:
            out.abandon()
        raise
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller page_id has; pages: (page_id, digest, n_bytes)."""
    large = pages.filter(F.col("n_bytes") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null")
    later = large.join(first, "digest").filter("page_id is null or page_id > refers_to")
    return later.groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as packages in folder; returns the manifest, a table beside them."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    narrow = saved(rows.select("page_id", "digest", F.octet_length("html").alias("n_bytes")))
    found = saved(revisits(narrow))
    again = found.withColumnsRenamed({"page_id": "id", "digest": "key"})
    # html moves only where the revisits are too many to send to every task, and is never sorted.
    again = F.broadcast(again) if found.count() <= BROADCAST_ROWS else again.hint("shuffle_hash")
    rows = rows.join(again, rows.page_id.eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key")), "left").drop("id", "key")
    where = qualified(spark, folder)
    rows.mapInArrow(tidy(lambda it: _write(it, where, date, package_bytes)), MANIFEST).write.parquet(f"{folder}/manifest")
    forget(spark, narrow, found)
    return spark.read.parquet(f"{folder}/manifest")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


# ---- reading


def central_directory(file, size: int) -> list[dict]:
    """Members of a ZIP file as its directories give them: name, method, bytes stored, and the offset of the local header."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - (22 + FULL16))
    tail = at(tail_at, size - tail_at)
    spot = tail.rfind(END)
    if spot < 0 or len(tail) - spot < 22:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, spot + 10)
    end = tail_at + spot
    if FULL16 == count or FULL32 in (length, offset):
        locator = at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR64:
            record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
    data, spot, members = at(offset, length), 0, []
    for _ in range(count):
        if data[spot : spot + 4] != CENTRAL or spot + 46 > len(data):
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", data, spot + 8)
        stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, spot + 20)
        header = struct.unpack_from("<I", data, spot + 42)[0]
        name = data[spot + 46 : spot + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[spot + 46 + n_name : spot + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: 64-bit values of the full fields alone, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain, stored, header = (next(wide) if v == FULL32 else v for v in (plain, stored, header))
            extra = extra[4 + n :]
        members.append({"name": name, "method": method, "encrypted": bool(flags & 1), "size": stored, "header": header})
        spot += 46 + n_name + n_extra + n_note
    return members


def data_start(file, member: dict) -> int:
    """Where a member's bytes begin: the local header has lengths of its own."""
    file.seek(member["header"])
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def _is_archive(name: str) -> bool:
    return name.startswith("archive/") and name.endswith((".warc", ".warc.gz"))


def _is_index(name: str) -> bool:
    return name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))


def package_pieces(path: str, piece_bytes: int = PIECE_BYTES) -> Iterator[dict]:
    """What tasks read of a package: pieces of its indexes, or whole archive members where it has none."""
    fs, where = opened(path)
    try:
        with fs.open_input_file(where) as file:
            members = central_directory(file, file.size())
            found = [m for m in members if _is_archive(m["name"]) or _is_index(m["name"])]
            for m in found:
                if m["method"] != 0 or m["encrypted"]:
                    raise ValueError(f"{m['name']} is not stored as it is")
                m["start"] = data_start(file, m)
    except (ValueError, struct.error) as e:
        raise ValueError(f"{path}: {e}") from e
    archives = [{k: m[k] for k in ("name", "start", "size")} for m in found if _is_archive(m["name"])]
    indexes = [m for m in found if _is_index(m["name"])]
    for m in indexes or archives:
        whole = {"path": path, "member": m["name"], "bound": m["start"] + m["size"], "archives": archives if indexes else []}
        step = max(1, m["size"]) if not indexes or m["name"].endswith(".gz") else piece_bytes
        for at in range(m["start"], m["start"] + m["size"], step):
            yield whole | {"start": at, "stop": min(at + step, whole["bound"]), "first": at == m["start"]}


def index_lines(file, piece: dict) -> Iterator[bytes]:
    """The lines that begin in a piece; the one cut at its start belongs to the piece before, the one cut at its end is read out."""
    if piece["member"].endswith(".gz"):
        file.seek(piece["start"])
        text = zlib.decompressobj(47).decompress(file.read(piece["stop"] - piece["start"]))
        yield from text.splitlines()
        return
    # From the byte before: a line belongs to the piece in which it begins. The byte before the member is part of its header.
    begin = piece["start"] - (0 if piece["first"] else 1)
    file.seek(begin)
    text = file.read(piece["stop"] - begin)
    while not text.endswith(b"\n") and begin + len(text) < piece["bound"]:
        more = file.read(min(4096, piece["bound"] - begin - len(text)))
        text += more[: more.find(b"\n") + 1] or more
    if not piece["first"]:
        text = text.partition(b"\n")[2]
    yield from text.split(b"\n")


def parse_record(data: bytes) -> dict:
    """A record's fields; payload: what follows the HTTP head of a response, or the block of other kinds; none of a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind, length, payload = fields.get("warc-type"), None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    bare = lambda v: v[1:-1] if v and v[:1] == "<" and v[-1:] == ">" else v
    return {
        "record_type": kind, "record_id": bare(fields.get("warc-record-id")), "target_uri": bare(fields.get("warc-target-uri")),
        "refers_to": bare(fields.get("warc-refers-to")), "digest": fields.get("warc-payload-digest"),
        "content_length": length, "payload": None if kind == "revisit" else payload,
    }


def fetch(file, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """The bytes at (offset, length) pairs, in order of offset; neighbours are read at once."""
    ranges = sorted(ranges)
    i = 0
    while i < len(ranges):
        begin, stop, k = ranges[i][0], sum(ranges[i]), i + 1
        while k < len(ranges) and ranges[k][0] <= stop and sum(ranges[k]) - begin <= FETCH_BYTES:
            stop, k = max(stop, sum(ranges[k])), k + 1
        file.seek(begin)
        data = file.read(stop - begin)
        for at, n in ranges[i:k]:
            yield at, data[at - begin : at - begin + n]
        i = k


def scan(file, start: int, size: int, gz: bool) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of all records of an archive member, read front to back."""
    file.seek(start)
    left, buffer, at = size, b"", 0

    def more() -> bool:
        nonlocal left, buffer
        data = file.read(min(FETCH_BYTES, left)) if left else b""
        left -= len(data)
        buffer += data
        return bool(data)

    while buffer or more():
        if gz:
            press, out = zlib.decompressobj(31), io.BytesIO()
            rest, used = buffer, 0
            while True:
                out.write(press.decompress(rest))
                if press.eof:
                    used = len(buffer) - len(press.unused_data)
                    break
                held = len(buffer)
                if not more():
                    raise ValueError("a record is cut short")
                rest = buffer[held:]
            record = out.getvalue()
        else:
            while (cut := buffer.find(b"\r\n\r\n")) < 0:
                if not more():
                    raise ValueError("a record is cut short")
            sizes = [x.partition(b":")[2] for x in buffer[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            used = cut + 4 + int(sizes[0]) + 4
            while len(buffer) < used and more():
                pass
            record = buffer[:used]
        yield at, used, record
        at, buffer = at + used, buffer[used:]


def piece_records(piece: dict) -> Iterator[dict]:
    """Records of one piece."""
    fs, where = opened(piece["path"])
    with fs.open_input_file(where) as file:
        if not piece["archives"]:
            for at, n, data in scan(file, piece["start"], piece["stop"] - piece["start"], piece["member"].endswith(".gz")):
                yield {"path": piece["path"], "offset": piece["start"] + at, "length": n} | parse_record(data)
            return
        by_name = {a["name"].rpartition("/")[2]: a for a in piece["archives"]}
        ranges, packed = [], set()
        for line in index_lines(file, piece):
            spot = line.find(b"{")
            if spot < 0:
                continue
            entry = json.loads(line[spot:])
            home = by_name[entry["filename"].rpartition("/")[2]]
            ranges.append((home["start"] + int(entry["offset"]), int(entry["length"])))
            if home["name"].endswith(".gz"):
                packed.add(ranges[-1][0])
        for at, data in fetch(file, ranges):
            record = zlib.decompress(data, 31) if at in packed else data
            yield {"path": piece["path"], "offset": at, "length": len(data)} | parse_record(record)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = FETCH_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"") + 256
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def read_packages(packages: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Every record of the packages (path), as RECORDS; offsets count from the start of the package."""
    spark = packages.sparkSession
    piece_schema, record_schema = _arrow(spark, PIECES), _arrow(spark, RECORDS)

    def directories(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _batches(package_pieces(path, piece_bytes), piece_schema)

    def records(batches):
        for batch in batches:
            for piece in batch.to_pylist():
                yield from _batches(piece_records(piece), record_schema)

    pieces = packages.select("path").repartition(partitions(spark)).mapInArrow(tidy(directories), PIECES)
    return pieces.repartition(partitions(spark)).mapInArrow(tidy(records), RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """A row per page record: payload size and digest (of the bytes read; of what it revisits, by the record's own fields), and what it revisits."""
    number = lambda c: F.expr(f"try_cast(nullif(substring_index({c}, ':', -1), '') as bigint)")
    return records.select(
        number("record_id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("content_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to packages (in the shared folder, if none is named) and read back."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    return page_records(read_packages(write_packages(pages, folder)))
