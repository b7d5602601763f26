"""Arrays cut anywhere, against the standard library's parser."""

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequill.sources import json_array as ja


def by_ranges(data, size, block, monkeypatch):
    """Elements by ranges of `size` bytes, and the most bytes any one range read."""
    monkeypatch.setattr(ja, "BLOCK_BYTES", block)
    cuts = [(i, min(i + size, len(data))) for i in range(0, len(data), size)]
    rows = []
    for k, (a, b) in enumerate(cuts):
        ends, depths, first = ja.summary(io.BytesIO(data), a, b)
        rows.append({"path": "p", "size": len(data), "k": k, "start": a, "stop": b, "ends": ends, "depths": depths, "first": first})
    random.Random(1).shuffle(rows)
    found = []
    for r in ja._compose(None, pa.Table.from_pylist(rows, ja._arrow(ja._SUMMARIES))).to_pylist():
        found += list(ja.elements(io.BytesIO(data), r["start"], r["stop"], r["size"], r["state"], r["depth"], r["whole"]))
    for offset, text in found:
        assert data[offset : offset + len(text)] == text
    return [t for _, t in sorted(found)]


TRICKY = [
    '[{"a":"]},[{\\"\\\\"},{"b":[1,[2,{"c":"\\\\\\\\"}],"é😀\\u00e9"]},"x,\\\\",-1.5e3, null ,[],{},"",[[[]]],true]', "[]", "[ \n ]", "[1,2,]", " \t[\n1\n,\n2\n]\n", "\ufeff[{},1]", '["\\\\","\\"","\\\\\\""]', "[[1,2],[3]]", "[7]",
]


@pytest.mark.parametrize("text", TRICKY)
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_every_cut_gives_the_same(text, block, monkeypatch):
    data = text.encode()
    want = json.loads(text.removeprefix("\ufeff").replace(",]", "]"))
    for size in range(1, len(data) + 2):
        assert [json.loads(t) for t in by_ranges(data, size, block, monkeypatch)] == want


def test_random_documents(monkeypatch):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 3)
        text = "".join(rng.choice('ab"\\[]{},:é😀\n') for _ in range(rng.randrange(6)))
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 4:
            return {f"{text}{i}": value(depth + 1) for i in range(rng.randrange(3))}
        return text if kind == 0 else rng.random() if kind == 1 else None

    for _ in range(150):
        want = [value(0) for _ in range(rng.randrange(8))]
        data = json.dumps(want, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        assert [json.loads(t) for t in by_ranges(data, rng.randrange(1, 40), rng.choice([2, 7, 64]), monkeypatch)] == want


def test_cut_files_objects_and_what_is_no_array(monkeypatch):
    assert by_ranges(b'[{"a":1},{"b":"x', 4, 3, monkeypatch) == [b'{"a":1}']
    assert by_ranges(b'[1,2', 2, 3, monkeypatch) == [b"1"]
    assert by_ranges(b' {"a":[1,{"b":2}]} tail', 5, 3, monkeypatch) == [b'{"a":[1,{"b":2}]}']
    assert by_ranges(b"[1] [2]", 2, 3, monkeypatch) == [b"1", b"2"]
    assert by_ranges(b'{"a":1}\n{"b":[{}]}\n', 3, 2, monkeypatch) == [b'{"a":1}', b'{"b":[{}]}']
    assert by_ranges(b"  \n ", 2, 3, monkeypatch) == []
    with pytest.raises(ValueError, match="neither"):
        by_ranges(b"hello [1]", 4, 3, monkeypatch)


def test_a_range_reads_itself_and_one_element(monkeypatch):
    """Bytes read by a range's task: no more than the range, the element it ends in, and a block."""
    data = ("[" + ",".join(json.dumps({"i": i, "t": "x" * (i % 50)}) for i in range(4000)) + "]").encode()

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.read_bytes += len(out)
            return out

    monkeypatch.setattr(ja, "BLOCK_BYTES", 256)
    state, depth = ja.PLAIN, 0
    for a in range(0, len(data), 5000):
        b = min(a + 5000, len(data))
        Counting.read_bytes = 0
        list(ja.elements(Counting(data), a, b, len(data), state, depth, False))
        assert Counting.read_bytes <= 5000 + 100 + 2 * 256
        ends, depths, _ = ja.summary(io.BytesIO(data), a, b)
        state, depth = ends[state], depth + depths[state]


def test_files_are_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": i, "text": f'"[{i}]\\' * (i % 7), "deep": {"x": [i]}} for i in range(3000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.json").write_text(json.dumps(rows[:10], indent=2))
    (tmp_path / "empty.json").write_text("")
    found = ja.read_elements(spark, str(tmp_path), range_bytes=1000)
    got = ja.elements_as(found, "id long, text string, deep struct<x:array<long>>")
    assert sorted((r.id, r.text, r.deep.x) for r in got.collect()) == sorted((r["id"], r["text"], r["deep"]["x"]) for r in rows + rows[:10])
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_arrays_written_by_partition(spark, tmp_path):
    frame = spark.range(50).repartition(3)
    ja.write_arrays(frame, str(tmp_path / "a"), F.to_json(F.struct("id")))
    assert sorted(r.id for r in ja.elements_as(ja.read_elements(spark, str(tmp_path / "a"), 64), "id long").collect()) == list(range(50))
