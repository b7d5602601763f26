"""ZIP-packaged archives: round trips, directories beyond 32 bits, pieces, scans, and what must fail."""

import hashlib
import io
import json
import zipfile
import zlib
from collections import Counter

import pytest

from tracequill.llm import queries, warc


def brute(pages):
    """Counter of (page_id, bytes, digest, type, refers_to); pages: [(id, html)]."""
    out, first = Counter(), {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, h in pages:
        data = (h or "").encode()
        least = first.get(h or "")
        again = len(data) >= 100 and least is not None and (i is None or least < i)
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None] += 1
    return out


def rows_of(frame):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect())


def test_op12_equals_brute_force(spark, tables):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    assert rows_of(queries.op12_warc(spark, tables)) == brute(pages)


PAGES = [
    (5, "u\r\nWARC-Type: x", "copy " * 40), (3, "http://a/ä b", "copy " * 40), (9, None, "copy " * 40), (None, "n", "copy " * 40), (3, "again", "copy " * 40),
    (7, "s", "short"), (8, "s", "short"), (1, "e", None), (2, "e", ""), (11, "bin", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (12, "x", "é" * 50), (13, "x", "é" * 50),
    (14, "long", "long page 😀 " * 90_000), (None, "m", "other " * 30), (15, "y", "y" * 99), (16, "y", "y" * 99), (17, "y", "y" * 100), (18, "y", "y" * 100),
]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "own", 1) for p in PAGES], "page_id long, url string, html string, digest string, n_bytes int")


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_op12_odd_rows_by_either_join(spark, pages, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    assert rows_of(warc.archive_pages(pages)) == brute([(i, h) for i, _, h in PAGES])


def test_op12_empty_table(spark, pages):
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_small_packages_and_index_pieces_of_any_size(spark, pages, tmp_path):
    manifest = warc.write_packages(pages, f"file://{tmp_path}/a", package_bytes=400)
    listed = manifest.collect()
    assert len(listed) > 3 and sum(r.n_records for r in listed) == len(PAGES)
    want = brute([(i, h) for i, _, h in PAGES])
    for size in (1, 7, 150, 1 << 20):
        assert rows_of(warc.page_records(warc.read_packages(manifest, piece_bytes=size))) == want
    for r in listed:  # an outside reader agrees about the packages
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def record(i, payload, refers_to=None):
    return warc.record_bytes(i, f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), refers_to, "2020-01-01T00:00:00Z")


def read(spark, path, **more):
    frame = spark.createDataFrame([(f"file://{path}",)], "path string")
    return {(r.page_id, r.payload_bytes, r.record_type) for r in warc.page_records(warc.read_packages(frame, **more)).collect()}


@pytest.mark.parametrize("gz", [False, True])
def test_member_without_index_is_scanned(spark, tmp_path, monkeypatch, gz):
    monkeypatch.setattr(warc, "FETCH_BYTES", 100)
    records = [record(i, b"p" * (i * 37)) for i in range(30)]
    data = b"".join(zlib.compress(r, wbits=31) if gz else r for r in records)
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/a.warc" + ".gz" * gz, data)
        z.writestr("pages/pages.jsonl", "{}")
    piece = next(warc.package_pieces(str(tmp_path / "a.wacz")))
    assert [r["payload"] for r in warc.piece_records(piece)] == [b"p" * (i * 37) for i in range(30)]
    assert read(spark, tmp_path / "a.wacz") == {(i, i * 37, "response") for i in range(30)}


def test_directories_beyond_32_bits(spark, tmp_path):
    path = tmp_path / "far.wacz"
    one, two = record(1, b"first"), record(2, b"second" * 30)
    with open(path, "wb") as f:
        f.truncate(5 << 30)  # a hole: offsets beyond four gigabytes without their bytes
    with zipfile.ZipFile(path, "a", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc", one)
        z.writestr("archive/b.warc", two)
        lines = [{"filename": "b.warc", "offset": 0, "length": len(two)}, {"filename": "a.warc", "offset": "0", "length": len(one)}]
        z.writestr("indexes/index.cdx.gz", zlib.compress("".join(f"k 2020 {json.dumps(x)}\n" for x in lines).encode(), wbits=31))
        z.comment = b"a note after the directory"
    with open(path, "rb") as f:
        members = warc.central_directory(f, path.stat().st_size)
    assert all(m["header"] >= 5 << 30 for m in members)
    assert read(spark, path) == {(1, 5, "response"), (2, 180, "response")}


def test_more_than_65535_members(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    assert len(warc.central_directory(data, len(data.getvalue()))) == 66_000


def test_deflated_or_broken_packages_are_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", record(1, b"x" * 500))
    with pytest.raises(ValueError, match="d.wacz.*not stored"):
        list(warc.package_pieces(str(tmp_path / "d.wacz")))
    (tmp_path / "e.wacz").write_bytes(b"no archive at all")
    with pytest.raises(ValueError, match="e.wacz.*central directory"):
        list(warc.package_pieces(str(tmp_path / "e.wacz")))


def test_failed_attempts_leave_nothing(tmp_path):
    def rows():
        import pyarrow as pa

        yield pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "html": b"x", "digest": "d", "refers_to": None}])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        list(warc._write(rows(), str(tmp_path / "out"), "2020-01-01T00:00:00Z", 1 << 20))
    assert list((tmp_path / "out").iterdir()) == []
