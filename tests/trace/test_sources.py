"""Readers on small files of our own."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tracequill import schema
from tracequill.operators import core, heap, memory
from tracequill.sinks import exports, reports
from tracequill.sources import binary, files


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_events(spark, tmp_path):
    rows = [
        {"channel": "db:q", "eventType": "start", "timestamp": 5, "operationId": "1", "context": {"server.address": "h"}},
        {"channel": "db:q", "eventType": "error", "timestamp": 9, "operationId": "1", "error": {"message": "boom", "code": 3}},
        {"channel": "", "eventType": "end", "timestamp": 1}, {"channel": "x:y", "eventType": "end"},
    ]
    got = files.read_events(spark, put(tmp_path, "e.json", rows))
    assert [(r.seq, r.event_type, r.error_message) for r in got.orderBy("seq").collect()] == [(0, "start", None), (1, "error", "boom")]
    assert json.loads(got.filter("seq = 0").first().context_json) == {"server.address": "h"}
    assert [(r.status, r.duration_ms) for r in core.pair_operations(got).collect()] == [("error", 4.0)]


def test_gc_log_and_memory(spark, tmp_path):
    log = "[1:0x1]  100 ms: Scavenge 10.0 (20.0) -> 5.5 (20.0) MB, 1.5 / 0.5 ms\nnoise\n[1:0x1]  900 ms: Mark-sweep 90.0 (99.0) -> 80.0 (99.0) MB, 6.0 / 0.0 ms"
    s = memory.gc_summary(files.read_gc_log(spark, put(tmp_path, "gc.log", log))).first()
    assert (s.runs, s.major, s.pause_ms, s.growth_mb, s.unmanaged) == (2, 1, 8.0, 70.0, True)
    rows = [{"ts": 1000 * i, "rss": 3 * 1048576 * i, "heapUsed": 5, "heapTotal": 9, "external": 0} for i in range(10)]
    g = memory.growth(files.read_memory(spark, put(tmp_path, "m.json", rows))).first()
    assert (g.rss_mb_s, g.heap_mb_s, g.flagged) == (3.0, 0.0, True)


def test_otlp(spark, tmp_path):
    span = {"traceId": "t", "spanId": "s", "name": "", "kind": 2, "startTimeUnixNano": "1710000000000000000", "endTimeUnixNano": "1710000001000000000", "status": {"code": 2}}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "pay"}}]}, "scopeSpans": [{"spans": [span]}]}]}
    got = files.read_otlp(spark, put(tmp_path, "o.json", doc)).orderBy("ts_ms").collect()
    assert [(r.service, r.channel, r.event_type, r.ts_ms) for r in got] == [("pay", "otel.span", "start", 1710000000000.0), ("pay", "otel.span", "error", 1710000001000.0)]


def test_cpu_profile(spark, tmp_path):
    frame = lambda n: {"functionName": n, "url": "", "lineNumber": 1}
    doc = {"nodes": [{"id": 1, "callFrame": frame("root"), "children": [2, 3]}, {"id": 2, "callFrame": frame("a"), "children": [4]}, {"id": 3, "callFrame": frame("")}, {"id": 4, "callFrame": frame("b")}], "samples": [4, 4, 2, 3], "timeDeltas": [1000, 2000, 3000, 4000]}
    got = {r.function: (r.hits, r.self_ms, r.total_ms) for r in heap.cpu_functions(*files.read_cpu_profile(spark, put(tmp_path, "c.cpuprofile", doc))).collect()}
    assert got == {"root": (0, 0.0, 10.0), "a": (1, 3.0, 6.0), "b": (2, 3.0, 3.0), "(anonymous)": (1, 4.0, 4.0)}


def test_heap_snapshot(spark, tmp_path):
    meta = {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": [["object", "string"], "string"], "edge_fields": ["type", "name_or_index", "to_node"]}
    doc = {"snapshot": {"meta": meta}, "nodes": [0, 0, 1, 10, 2, 0, 1, 3, 20, 1, 1, 2, 5, 30, 0], "edges": [0, 1, 5, 0, 2, 10, 0, 2, 10], "strings": ["root", "cache", "text"]}
    nodes, edges = files.read_heap_snapshot(spark, put(tmp_path, "h.heapsnapshot", doc))
    assert sorted((r.from_id, r.to_id) for r in edges.collect()) == [(1, 3), (1, 5), (3, 5)]
    got = {r.name: (r.type, r.retained_size) for r in heap.retained_sizes(nodes, edges).collect()}
    assert got == {"root": ("object", 60), "cache": ("object", 50), "text": ("string", 30)}


def test_formats_in_one_folder(spark, tmp_path):
    event = {"channel": "db:q", "eventType": "start", "timestamp": 5, "context": {}}
    span = {"spanId": "s", "name": "n", "startTimeUnixNano": "1710000000000000000", "endTimeUnixNano": "1710000001000000000", "attributes": [{"key": "k", "value": {"boolValue": True}}, {"key": "k", "value": {"intValue": "2"}}]}
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps([event, event]))
    put(tmp_path, "b.json", {"spans": [span]})
    got = files.read_trace(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.format, r.event_type) for r in got] == [("native", "start"), ("native", "start"), ("otel", "start"), ("otel", "end")]
    assert len({r.seq for r in got}) == 4 and json.loads(got[2].context_json)["k"] == "2"
    put(tmp_path, "c.json", [{"a": 1}])
    with pytest.raises(Exception, match="Neither an array"):
        files.read_trace(spark, str(tmp_path)).collect()


def test_binary_files(spark, tmp_path):
    rows = [(1, 0, "db:q", "start", 5.5, "1", None, "{}", None), (1, 1, "db:q", "error", 9.0, "1", 3.5, '{"a":1}', "boom"), (2, 0, "x:ä", "asyncEnd", 1.0, None, None, "{}", None)]
    events = spark.createDataFrame(rows, "run long, seq long, channel string, event_type string, ts_ms double, operation_id string, duration_ms double, context_json string, error_message string")
    sizes = {r.run: r.bytes for r in binary.write_ndv(events, "run", str(tmp_path / "out")).collect()}
    assert sizes == {k: (tmp_path / "out" / f"{k}.ndv").stat().st_size for k in (1, 2)}
    got = binary.read_ndv(spark, str(tmp_path / "out")).orderBy("file", "pos").collect()
    assert [(r.channel, r.event_type, r.ts_ms, r.operation_id, r.duration_ms, r.error_message, r.context_json) for r in got] == [
        ("db:q", "start", 5.5, "1", None, None, None), ("db:q", "error", 9.0, "1", 3.5, "Error: boom", '{"a":1}'), ("x:ä", "asyncEnd", 1.0, None, None, None, None),
    ]
    data = (tmp_path / "out" / "1.ndv").read_bytes()
    for bad in (data[:-3], b"XXX" + data[3:], data[:3] + b"\x09" + data[4:], b""):
        with pytest.raises(ValueError):
            binary.decode(bad)


def test_jit_log_file(spark, tmp_path):
    log = """LoadIC[0] (0x1c000000) at a.js:1:2 offset 7: [key: k] map 0xaa 0xbb
[deoptimizing (DEOPT eager): begin 0x2c <fn> at a.js:1:2]
[bailout (kind: deopt-eager, reason: Map check)]
[deoptimizing (DEOPT eager): end 0x2c <fn>]
[compiling method 0x2d <SharedFunctionInfo g> using TurboFan] OSR
Map transition from 0xaa to 0xbb for "x" at a.js:3:4
no line of ours"""
    got = files.read_jit_log(spark, put(tmp_path, "v.log", log)).orderBy("seq").collect()
    assert [(r["class"], r.kind, r.reason) for r in got] == [("ic", "LoadIC", None), ("deopt", "eager", "Map check"), ("bailout", "eager", "Map check"), ("deopt", "eager", "Map check"), ("opt", "osr", "TurboFan"), ("map", "transition", None)]
    assert (got[0].maps, got[0].state, got[0].offset, got[0].key) == (["0xaa", "0xbb"], "polymorphic", 7, "k")


def test_lines_of_compiler_logs(spark):
    log = [
        "LoadIC[0] (0x1c00) at demo.js:8:25 offset 17: [key: name] map 0x02d8", "StoreIC (0x1d00)\tat demo.js:6:13 offset 42: [key: id] map 0x02d8 0x02d9 0x02d8",
        "KeyedStoreIC[1] at demo.js:30:10 offset 4: [key: 0] map 0x02db [slow]", "[LoadIC in optimized code] (0x1e) map 0xaa", "CallIC at x.js:1:1 uninitialized", "  a line that only speaks of a PIC18 or of an IC",
        "[marking 0x2c <SharedFunctionInfo f> for optimized recompilation, reason: Small function, again]", "[marking 0x2c <SharedFunctionInfo f> without a cause]", "[compiling method 0x2c <SharedFunctionInfo f> using TurboFan OSR]",
        "[compiling method 0x2c <SharedFunctionInfo f> using TurboFan] OSR", "[optimizing 0x2c <SharedFunctionInfo f> - took 0.012 ms]", "[optimizing 0x2c <SharedFunctionInfo >]", "[reoptimizing 0x2c <SharedFunctionInfo f>",
        "[deoptimizing (DEOPT lazy): begin 0x2c <f> at demo.js:6:13]", "[deoptimizing (DEOPT lazy): begin 2c <f>]", "[deoptimizing (DEOPT lazy): end 0x2c <f>, took 1 ms]",
        "Map transition from 0x1 to 0x2", "Map[x] transition from 0x1 to 0x2 at a.js:1:1", 'Map transition from 0x1 to 0x2 for "p"', "a Map transition from 0x1 to 0x2", "[bailout (kind: deopt-eager, reason: wrong map)] and more",
    ]
    from tracequill.operators import jit

    got = {r.seq: r for r in jit.parse(spark.createDataFrame([("s", i, x) for i, x in enumerate(log)], "series string, seq long, line string")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 15, 16, 17, 18, 20]
    assert [(got[i].kind, got[i].site, got[i].offset, got[i].key, got[i].state, got[i].maps) for i in range(5)] == [
        ("LoadIC", "demo.js:8:25", 17, "name", "monomorphic", ["0x02d8"]), ("StoreIC", "demo.js:6:13", 42, "id", "polymorphic", ["0x02d8", "0x02d9"]),
        ("KeyedStoreIC", "demo.js:30:10", 4, "0", "megamorphic", ["0x02db"]), ("LoadIC", None, None, None, "monomorphic", ["0xaa"]), ("CallIC", "x.js:1:1", None, None, "uninitialized", []),
    ]
    assert [(got[i].kind, got[i].name, got[i].reason, got[i].compiler, got[i].took_ms) for i in (6, 9, 10, 11, 12)] == [
        ("marking", "f", "Small function", None, None), ("osr", "f", "TurboFan", "TurboFan", None), ("optimized", "f", "0.012", None, 0.012), ("optimized", None, None, None, None), ("reoptimize", "f", None, None, None),
    ]
    assert [(got[i].kind, got[i].address, got[i].site, got[i].begins) for i in (13, 15)] == [("lazy", "0x2c", "demo.js:6:13", True), ("lazy", "0x2c", None, False)]
    assert [(got[i].address, got[i].target, got[i].key, got[i].site) for i in (16, 17, 18)] == [("0x1", "0x2", None, None), ("0x1", "0x2", None, "a.js:1:1"), ("0x1", "0x2", "p", None)]
    assert (got[20].kind, got[20].reason) == ("eager", "wrong map")
    assert [r.id for r in jit.sites(jit.parse(spark.createDataFrame([("s", 1, "LoadIC 0x1")], "series string, seq long, line string"))).collect()] == ["LoadIC@<anonymous>"]


def test_reasons_pass_along_a_long_log_in_linear_time(spark):
    from tracequill.operators import jit

    line = F.when(F.col("id") % 5 == 0, "[bailout (kind: deopt-eager, reason: why)]").when(F.col("id") % 5 == 3, "[deoptimizing (DEOPT eager): end 0x2c <f>]").otherwise("[deoptimizing (DEOPT eager): begin 0x2c <f>]")
    frame = spark.range(50_000).select(F.lit("one log").alias("series"), F.col("id").alias("seq"), line.alias("line"))
    began = time.perf_counter()
    rows = jit.parse(frame).groupBy(F.col("seq") % 5, "reason").count().collect()
    assert time.perf_counter() - began < 60
    assert {(r[0], r.reason): r["count"] for r in rows} == {(0, "why"): 10_000, (1, "why"): 10_000, (2, "why"): 10_000, (3, "why"): 10_000, (4, "why"): 9_999, (4, None): 1}


def test_lines_of_collector_logs(spark):
    from tracequill.operators import memory

    log = [
        "[82365:0x158001600]    11623 ms: Scavenge 78.6 (92.8) -> 69.5 (93.8) MB, 1.9 / 0.0 ms  (average mu = 0.994, current mu = 0.994) allocation failure",
        "[1:0x1]\t12456 ms:\tMark-sweep\t93.8 (109.6)->84.2 (107.2) MB, 6.3/0.5ms  more", "12 ms: Mark-sweep (reduce) 93.8 (109.6) -> 84.2 (107.2) MB, 6.3 / 0.0 ms", "11623 ms: Scavenge 78.6 -> 69.5 MB", "nothing", "",
    ]
    got = memory.gc_entries(spark.createDataFrame(list(enumerate(log)), "seq long, line string")).orderBy("seq").collect()
    assert [(r.seq, r.ts_ms, r.type, r.heap_before, r.heap_after, r.pause_ms, r.pause_type) for r in got] == [
        (0, 11623, "Scavenge", int(78.6 * 1048576), int(69.5 * 1048576), 1.9, "minor"), (1, 12456, "Mark-sweep", int(93.8 * 1048576), int(84.2 * 1048576), 6.8, "major"),
    ]


def test_reports(spark):
    document = {"version": 1, "eventSummary": {"channels": [{"channel": "a<b", "total": 2}], "totalEvents": 4, "totalOperations": 2, "errorRate": 0.5}, "keyFindings": ["slow"]}
    assert reports.from_text(reports.to_text(document)) == document
    assert "| a<b | 2 |" in reports.to_markdown(document) and "a&lt;b" in reports.to_html(document)
    assert "failed" in reports.gate_markdown([{"rule": "r", "status": "fail", "actual": 2.0, "threshold": 1.0}])
    assert reports.heap_findings(1048576, 2) == ["Heap analysis found 2 potential leak(s)", "Heap total: 1.0MB"]
    span = exports.event_spans(spark.createDataFrame([(1, "c:c", "error", 5.0, "7", 2.0, '{"traceId":"t","deep":{"a":1}}', "boom")], "seq long, channel string, event_type string, ts_ms double, operation_id string, duration_ms double, context_json string, error_message string")).first()
    assert (span.traceId, span.spanId, span.endTimeUnixNano, span.status.code, len(span.attributes)) == ("t", "7" + "0" * 15, "7000000", 2, 2)


def test_command_line(spark, tmp_path, capsys):
    from tracequill import check

    rows = [{"channel": "web:a", "eventType": "start", "timestamp": 0, "operationId": "r"}]
    for i in range(3):
        rows += [{"channel": "mysql2:query", "eventType": t, "timestamp": 10 * i + k, "operationId": f"q{i}", "context": {"parentId": "r"}} for k, t in ((1, "start"), (5, "end"))]
    rows.append({"channel": "web:a", "eventType": "end", "timestamp": 100, "operationId": "r"})
    path = put(tmp_path, "t.json", rows)
    assert check.main([path]) == 1 and "n1-sql | fail" in capsys.readouterr().out
    assert check.main(["check", path, "--threshold", "n1SqlMaxCount=4", "--json", "--report", str(tmp_path / "r.md")]) == 0
    assert json.loads(capsys.readouterr().out)["passed"] and "passed" in (tmp_path / "r.md").read_text()
    assert check.main([path, "--threshold", "x=1"]) == check.main([str(tmp_path / "none.json")]) == check.main([put(tmp_path, "b.json", "{")]) == check.main([]) == 2


def test_as_of_join_over_many_ranges(spark):
    import random

    from tracequill.operators.asof import as_of

    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(500) if rng.random() < 0.97 else None) for i in range(900)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), rng.randrange(500), i) for i in range(300)] + [("hot", 250, 7)]
    frame, other = spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "k string, t int, v long")
    want = {}
    for i, k, t in left:
        best = max(((u, v) for j, u, v in right if None not in (k, t, j) and j == k and u <= t), default=None)
        want[i] = best and best[1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = {r.id: r.found and r.found.v for r in as_of(frame, other, ["k"], "t", ["v"], "found").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_packed_maps_read_back(spark):
    from tracequill.sources import sourcemap

    rows = [("m", 1, 0, "a.ts", 1, 0, None), ("m", 1, 7, "b.ts", 900, 4, "run"), ("m", 4, 2, "a.ts", 3, 40, None), ("m", 4, 1 << 20, "a.ts", 2, 0, "x"), ("n", 2, 5, "c.ts", 1, 1, None)]
    frame = spark.createDataFrame(rows, sourcemap.MAPPING)
    assert sorted(map(tuple, sourcemap.mappings(sourcemap.pack(frame)).collect()), key=repr) == sorted(rows, key=repr)


def test_folders_of_snapshots_and_profiles_keep_their_files_apart(spark, tmp_path):
    fields = ["type", "name", "id", "self_size", "edge_count"]
    for k in range(3):
        nodes, edges = [], []
        for i in range(40):
            out = (i + k) % 4
            nodes += [i % 2, i % 3, 10 * i + 1, 100 * k + i, out]
            for j in range(out):
                edges += [2, j, ((i + j + 1) % 40) * 5]
        meta = {"node_fields": fields, "node_types": [["object", "string"]], "edge_fields": ["type", "name_or_index", "to_node"]}
        put(tmp_path, f"{k}.heapsnapshot", {"snapshot": {"meta": meta}, "nodes": nodes, "edges": edges, "strings": ["a", "b", "c"]})
        tree = [{"id": 1, "callFrame": {"functionName": "", "url": "", "lineNumber": 0}, "children": [2]}, {"id": 2, "callFrame": {"functionName": f"f{k}", "url": "", "lineNumber": 1}}]
        put(tmp_path, f"{k}.cpuprofile", {"nodes": tree, "samples": [2] * (k + 1), "timeDeltas": [5]})
    for block in (1, 7, 1000):
        found, edges = files.read_heap_snapshot(spark, str(tmp_path / "*.heapsnapshot"), block)
        name = F.regexp_extract("file", r"(\d)\.heap", 1).cast("int").alias("k")
        assert {(r.k, r.id): (r.name, r.type, r.self_size) for r in found.select(name, "*").collect()} == {(k, 10 * i + 1): ("abc"[i % 3], ("object", "string")[i % 2], 100 * k + i) for k in range(3) for i in range(40)}
        assert sorted((r.k, r.from_id, r.to_id, r.name) for r in edges.select(name, "*").collect()) == sorted((k, 10 * i + 1, 10 * ((i + j + 1) % 40) + 1, str(j)) for k in range(3) for i in range(40) for j in range((i + k) % 4))
    nodes, samples = files.read_cpu_profile(spark, str(tmp_path / "*.cpuprofile"))
    assert sorted((r.id, r.parent_id, r.function) for r in nodes.collect()) == sorted([(1, None, "(anonymous)")] * 3 + [(2, 1, f"f{k}") for k in range(3)])
    assert sorted(r["count"] for r in samples.groupBy("file").count().collect()) == [1, 2, 3]


def test_binary_files_are_committed_whole(spark, tmp_path):
    rows = [(k, i, "a:q", "start", float(i), str(i), None, "{}", None) for k in ("a/b c", "_d+e", None) for i in range(3)]
    events = spark.createDataFrame(rows, "run string, " + schema.EVENT)
    out = tmp_path / "out"
    sizes = {r.run: r.bytes for r in binary.write_ndv(events, "run", str(out)).collect()}
    assert set(sizes) == {"a/b c", "_d+e", None} and len(list(out.iterdir())) == len([p for p in out.iterdir() if p.suffix == ".ndv" or p.name.endswith(".crc")])
    assert binary.read_ndv(spark, str(out)).count() == 9
    kept = {p.name: p.read_bytes() for p in out.iterdir()}
    broken = events.withColumn("ts_ms", F.expr("IF(run = '_d+e' AND seq = 2, CAST(raise_error('stop') AS DOUBLE), ts_ms)"))
    with pytest.raises(Exception, match="stop"):
        binary.write_ndv(broken, "run", str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == kept
    assert binary.write_ndv(events.filter("run = '_d+e'").limit(1), "run", str(out)).count() == 3
    assert binary.read_ndv(spark, str(out)).count() == 7


def test_a_failing_writer_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(binary.NdvSink)
    rows = spark.range(0, 8, 1, 4).select(F.concat(F.lit("k"), "id").alias("name"), F.expr("IF(id = 7, CAST(raise_error('stop') AS BINARY), CAST('x' AS BINARY))").alias("content"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("tracequill_ndv").option("uri", f"file://{tmp_path}/out").mode("append").save()
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_large_maps_are_written_and_read_in_sections(spark):
    """More mappings of one map than a section holds, some on one line: several documents, the same rows."""
    from tracequill.sources import sourcemap

    rows = [("m", 1 + i // 40 * 2, 3 + i % 40 * 5, f"{i % 3}.ts", 900 - i, i % 7, None if i % 4 else f"n{i % 5}") for i in range(500)] + [("n", 2, 5, "c.ts", 1, 1, None)]
    maps = sourcemap.pack(spark.createDataFrame(rows, sourcemap.MAPPING).repartition(3), section=30)
    assert {r.map_id: r["count"] for r in maps.groupBy("map_id").count().collect()}["m"] >= 500 / 30
    assert sorted(map(tuple, sourcemap.mappings(maps).collect()), key=repr) == sorted(rows, key=repr)


def test_a_map_longer_than_the_parsers_limit_is_read(spark):
    from tracequill.sources import sourcemap

    maps = spark.sql("""SELECT 'm' AS map_id, concat('{"version": 3, "sources": ["a.ts"], "names": ["', repeat('x', 21000000), '"], "mappings": "AAAA;AACA"}') AS json""")
    assert [tuple(r) for r in sourcemap.mappings(maps).collect()] == [("m", 1, 0, "a.ts", 1, 0, None), ("m", 2, 0, "a.ts", 2, 0, None)]
