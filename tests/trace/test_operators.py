"""Operators on small hand-made inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracequill import schema
from tracequill.functions.scalars import noise_kind
from tracequill.operators import causal, core, differential, distributed, signals
from tracequill.operators.trees import climb


def events(spark, rows):
    """rows: (channel, type, ts, operation id) in order of arrival."""
    full = [(i, c, t, float(ts), op, None, "{}", None) for i, (c, t, ts, op) in enumerate(rows)]
    return spark.createDataFrame(full, schema.EVENT)


def test_nearest_rank_percentiles(spark):
    rows = []
    for k in range(1, 11):
        rows += [("db:query", "start", k * 1000, str(k)), ("db:query", "end", k * 1000 + 10 * k, str(k))]
    (s,) = core.channel_stats(core.pair_operations(events(spark, rows))).collect()
    assert (s.p50_ms, s.p95_ms, s.p99_ms, s.avg_ms) == (50.0, 100.0, 100.0, 55.0)


def brute_pairs(rows):
    """Pending starts by key, in time order."""
    out, pending = [], {}
    for _, (c, t, ts, op) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        key = op if op is not None else f"{c}:{ts}"
        if t == "start":
            pending[key] = (c, ts)
        elif t in ("end", "error"):
            start = pending.pop(key, None)
            status = "error" if t == "error" else "success" if start else "incomplete"
            out.append((key, c, status, float(ts - start[1]) if start else 0.0))
    return sorted(out + [(k, c, "incomplete", 0.0) for k, (c, _) in pending.items()])


@pytest.mark.parametrize("seed", range(4))
def test_pairing_equals_pending_map(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab") + ":x", rng.choice(schema.EVENT_TYPES), rng.randint(0, 30), rng.choice([None, "1", "2", "3"])) for _ in range(80)]
    got = core.pair_operations(events(spark, rows)).collect()
    assert sorted((r.op_key, r.channel, r.status, r.duration_ms) for r in got) == brute_pairs(rows)


def test_empty_tables(spark):
    none = events(spark, [("a", "start", 1, "x")]).limit(0)
    ops = core.pair_operations(none)
    assert ops.count() == core.channel_stats(ops).count() == core.throughput(none).count() == core.validate(none).count() == 0
    assert core.summary(none, ops).first().error_rate == 0.0


def test_cycles_become_roots(spark):
    graph = spark.createDataFrame([("a", "c", 1.0), ("b", "a", 2.0), ("c", "b", 3.0), ("d", "c", 4.0), ("e", None, 5.0), ("f", "e", 6.0)], "id string, parent_id string, start_ms double")
    got = {r.id: (r.root, r.depth, r.cyclic) for r in causal.forest(graph).collect()}
    assert got == {"a": ("a", 0, True), "b": ("b", 0, True), "c": ("c", 0, True), "d": ("c", 1, False), "e": ("e", 0, False), "f": ("e", 1, False)}


def test_cycles_are_named_and_cut(spark):
    graph = spark.createDataFrame([("b", "c", 1.0), ("c", "d", 2.0), ("d", "b", 3.0), ("x", "y", 4.0), ("y", "x", 5.0), ("k", "d", 6.0), ("m", "k", 7.0)], "id string, parent_id string, start_ms double")
    assert sorted(r.id for r in causal.cycle_nodes(graph).collect()) == ["b", "c", "d", "x", "y"]
    assert {r.cycle: r.path for r in causal.cycle_paths(graph).collect()} == {"b": ["b", "d", "c", "b"], "x": ["x", "y", "x"]}
    rows = {r.id: (r.parent_id, r.depth) for r in causal.waterfall(graph.withColumn("virtual", F.lit(False))).collect()}
    assert rows["k"] == ("d", 1) and rows["m"] == ("k", 2) and rows["d"] == (None, 0)


def test_parents_of_operations_without_a_start(spark):
    rows = [
        (0, "a:a", "start", 0.0, "1", None, '{"asyncId": "7"}', None), (1, "a:a", "end", 1.0, "1", None, "{}", None), (2, "b:b", "end", 5.0, "2", None, '{"parent_span_id": "1"}', None),
        (3, "c:c", "error", 9.0, "3", None, '{"trigger_async_id": 7}', None), (4, "d:d", "end", 20.0, "4", None, '{"parent": "1"}', None), (5, "e:e", "end", 30.0, "5", None, "{}", None), (6, "e:e", "start", 29.0, "5", None, '{"async_id": "8"}', None),
        (7, "f:f", "end", 40.0, "6", None, '{"triggerAsyncId": "8"}', None),
    ]
    nodes = causal.causal_nodes(spark.createDataFrame(rows, schema.EVENT))
    got = {r.child_id: (r.parent_id, r.kind) for r in causal.causal_edges(nodes).collect()}
    assert got == {"2": ("1", "explicit-parent"), "3": ("1", "async-context"), "4": ("virtual:orphan:4", "gap-healed"), "6": ("virtual:orphan:6", "gap-healed")}


def test_noise_by_prefix_and_gaps(spark):
    kinds = ["http.get", "v8.gc", "node:v8.gc", "gcp:storage", "setTimeout", "node:timers", "dns:x", "node:net", "GC:x"]
    rows = spark.createDataFrame([(k,) for k in kinds], "c string").select("c", noise_kind(F.col("c")).alias("k")).collect()
    assert [r.k for r in rows] == ["tcp-handshake", "gc-pause", "gc-pause", None, None, "timer-jitter", "network-dns", "tcp-handshake", None]
    trace = events(spark, [("a:a", "start", 0, "1"), ("a:a", "end", 1, "1"), ("dns:x", "start", 100, "2"), ("dns:x", "end", 101, "2"), ("dns:x", "start", 300, "3")]).withColumn("run", F.lit(1))
    got = {(r.kind, r.first, r.last) for r in signals.noise_regions(trace, "run").collect()}
    assert got == {("inter-event-gap", 1, 2), ("network-dns", 3, 4)}


def test_search_with_a_broken_pattern_filters_nothing(spark):
    rows = events(spark, [('a:"q"', "start", 0, "1"), ("b:b", "end", 1, None)])
    assert core.search_text(rows, "(").count() == 2
    assert core.search_text(rows, '"operationId":"1"').count() == 1 and core.search_text(rows, 'a:\\"q\\"', literal=True).count() == 1


def brute_cost(a, b, sa, sb):
    d = [[2 * j for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [2 * i]
        for j in range(1, len(b) + 1):
            sub = 0 if a[i - 1] == b[j - 1] else 1 if sa[i - 1] == sb[j - 1] else 5
            row.append(min(d[i - 1][j - 1] + sub, d[i - 1][j] + 2, row[-1] + 2))
        d.append(row)
    return d[-1][-1]


def test_alignment_costs_equal_brute_force(spark):
    rng = random.Random(8)
    normal, fault = [], []
    for pair in range(40):
        run = [(rng.choice("wxyz") + ":q", rng.choice(["start", "end"]), rng.randint(0, 2)) for _ in range(rng.randint(0, 12))]
        other = [e for e in run if rng.random() > 0.2]
        other = [(c, t, v if rng.random() > 0.2 else 9) for c, t, v in other] + [(rng.choice("wxyz") + ":q", "end", 1) for _ in range(rng.randint(0, 2))]
        for out, events_ in ((normal, run), (fault, other)):
            out += [(pair, i, c, t, float(i), f"{pair}", None, json.dumps({"v": v, "requestId": rng.random()}), None) for i, (c, t, v) in enumerate(events_)]
    kind = "pair long, " + schema.EVENT
    a, b = (differential.normalise(spark.createDataFrame(x, kind), "pair") for x in (normal, fault))
    rows = differential.align(a, b, "pair").collect()
    side = lambda x: {(r.pair, r.i): (r.fingerprint, r.signature) for r in x.collect()}
    left, right = side(a), side(b)
    for pair in range(40):
        mine = [r for r in rows if r.pair == pair]
        n, m = sum(k[0] == pair for k in left), sum(k[0] == pair for k in right)
        assert sorted(r.normal_index for r in mine if r.normal_index >= 0) == list(range(n)) and sorted(r.fault_index for r in mine if r.fault_index >= 0) == list(range(m))
        fa, fb = [left[pair, i] for i in range(n)], [right[pair, i] for i in range(m)]
        assert sum(r.cost for r in mine) == brute_cost([x[0] for x in fa], [x[0] for x in fb], [x[1] for x in fa], [x[1] for x in fb])
        for r in mine:
            if r.kind == "match":
                assert left[pair, r.normal_index] == right[pair, r.fault_index]


def test_comparison_of_two_runs(spark):
    row = lambda i, c, t, v, err=None: (1, i, c, t, float(i), str(i // 2), None, json.dumps({"v": v}), err)
    normal = [row(0, "a:a", "start", 1), row(1, "a:a", "end", 1), row(2, "b:b", "start", 2), row(3, "b:b", "end", 2), row(4, "c:c", "start", 3)]
    fault = [row(0, "a:a", "start", 1), row(1, "a:a", "end", 1), row(2, "b:b", "start", 2), row(3, "b:b", "error", 2, "boom"), row(4, "c:c", "start", 3)]
    kind = "pair long, " + schema.EVENT
    got = differential.compare_runs(spark.createDataFrame(normal, kind), spark.createDataFrame(fault, kind), "pair")
    (point,) = got["divergences"].collect()
    assert (point.kind, point.role, point.size) == ("error-introduced", "cause", 2)
    assert got["regression"].first().confidence == 1.0 and "threw an error" in got["report"].first().report
    same = differential.compare_runs(spark.createDataFrame(normal, kind), spark.createDataFrame(normal, kind), "pair")
    assert same["summary"].first().similarity == 1.0 and same["divergences"].count() == 0 and same["regression"].count() == 0


def test_climb_on_a_long_chain(spark):
    n = 300
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, up long")
    got = {r.id: r.depth for r in climb(nodes, ["id"], "up", {}, {}).collect()}
    assert got == {i: i for i in range(n)}


def test_explicit_parent_gap_and_containment(spark):
    rows = [
        (0, "web:a", "start", 0.0, "1", None, "{}", None), (1, "db:b", "start", 1.0, "2", None, "{}", None), (2, "db:b", "end", 4.0, "2", None, "{}", None),
        (3, "db:c", "start", 5.0, "3", None, '{"parentOperationId":"2"}', None), (4, "db:c", "end", 6.0, "3", None, "{}", None),
        (5, "db:d", "start", 7.0, "4", None, '{"parentId":"gone"}', None), (6, "web:a", "end", 10.0, "1", None, "{}", None),
        (7, "db:e", "end", 20.0, "5", None, "{}", None),
    ]
    nodes = causal.causal_nodes(spark.createDataFrame(rows, schema.EVENT))
    got = {r.child_id: (r.parent_id, r.kind, r.confidence) for r in causal.causal_edges(nodes).collect()}
    # Operation 4 never ends, so it contains operation 5, which has no start of its own.
    assert got == {
        "2": ("1", "containment", "medium"), "3": ("2", "explicit-parent", "high"), "4": ("virtual:gone", "gap-healed", "low"), "5": ("4", "containment", "medium"),
    }


def test_skew_keeps_children_behind_parents(spark):
    rows = [("t", "1", None, "a", "x", 2, 100.0, 200.0, False, None), ("t", "2", "1", "b", "x", 2, 90.0, 150.0, False, None), ("t", "3", "2", "c", "x", 2, 80.0, 85.0, True, "boom")]
    linked = distributed.link_spans(spark.createDataFrame(rows, schema.SPAN))
    got = {r.span_id: round(r.adjusted_start_ms, 6) for r in distributed.correct_skew(linked).collect()}
    assert got == {"1": 100.0, "2": 100.001, "3": 100.002}


def test_ids_are_texts_or_numbers_and_the_first_record_names_the_channel(spark):
    kind = schema.EVENT
    rows = [
        (0, "end:first", "end", 5.0, "a", None, '{"parentId": true, "parentSpanId": "p"}', None, None), (1, "start:later", "start", 2.0, "a", None, '{"parentId": true, "parentSpanId": 7}', None, None),
        (2, "c:c", "start", 3.0, "b", None, '{"parentId": "true", "asyncId": [1], "triggerAsyncId": {"a": 1}}', None, None), (3, "c:c", "start", 3.0, "c", None, '{"parentId": "[x]", "asyncId": 12}', None, None),
        (4, "c:c", "start", 3.0, "d", None, "no json", None, None),
    ]
    names = [f.strip().split(" ")[0] for f in kind.split(",")]
    base = dict.fromkeys(names)
    keys = ("seq", "channel", "event_type", "ts_ms", "operation_id", "duration_ms", "context_json", "error_message")
    frame = spark.createDataFrame([tuple((base | dict(zip(keys, r, strict=False)))[n] for n in names) for r in rows], kind)
    got = {r.id: (r.channel, r.declared, r.async_id, r.trigger_id) for r in causal.causal_nodes(frame).collect()}
    assert got == {"a": ("end:first", "7", None, None), "b": ("c:c", "true", None, None), "c": ("c:c", "[x]", "12", None), "d": ("c:c", None, None, None)}


def test_stack_frames_of_every_form(spark):
    stack = "Error: x\n    at load (/a/b.js:3:4)\n  at /m.js:1:2\n\tat native\n at fn (native)\n at node:fs\n at async (/x/node_modules/node:y.js:9:9)\n at node::Run (/c.cc:1:1)\n at (/e.js:5:6)\nat <anonymous>\nnothing"
    got = [(r.function, r.file, r.line, r.col, r.filtered) for r in signals.stack_frames(spark.createDataFrame([(1, stack)], "id long, stack string")).orderBy("place").collect()]
    assert got == [
        ("load", "/a/b.js", 3, 4, False), ("[anonymous]", "/m.js", 1, 2, False), ("[anonymous]", "native", None, None, True), ("fn", "native", None, None, True), ("[anonymous]", "node:fs", None, None, True),
        ("async", "/x/node_modules/node:y.js", 9, 9, False), ("node::Run", "/c.cc", 1, 1, True), ("[anonymous]", "/e.js", 5, 6, False), ("[anonymous]", "<anonymous>", None, None, True),
    ]


def test_confidence_in_a_cause(spark):
    told = spark.createDataFrame([("a", 1, 0.2, ["x", "y", "z"]), ("b", 2, 0.19, ["x"])], "service string, rank int, score double, evidence array<string>")
    spans = spark.createDataFrame([(str(i),) for i in range(7)], "trace_id string")
    got = {r.service: r.confidence for r in distributed.confidence(told, spans).collect()}
    assert got == {"a": 0.703, "b": None}
    few = distributed.confidence(told.filter("rank = 1").withColumn("evidence", F.slice("evidence", 1, 1)), spans.limit(1)).first()
    assert few.confidence == round(0.45 + 0.3 * 0.2 + 0.03 + 0.1 / 3, 6)


def test_advice_where_nothing_stands_out(spark):
    ranked = spark.createDataFrame([("a", 1, "throughput")], "service string, rank int, signal string")
    spans = spark.createDataFrame([(False, None)], "error boolean, error_message string")
    assert [r.place for r in distributed.recommendations(ranked, spans).collect()] == [12]


def test_one_event_has_no_noise(spark):
    frame = spark.createDataFrame([("a", 0, "gc:run", "start", 0.0), ("b", 0, "timer:x", "start", 0.0), ("b", 1, "timer:x", "end", 1.0)], "run string, seq long, channel string, event_type string, ts_ms double")
    assert {r.run for r in signals.noise_regions(frame, "run").collect()} == {"b"}


def brute_nearest(rows, reach):
    """{id: parent}; rows: (scope, id, start, end, seq)."""
    out = {}
    for scope in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == scope), key=lambda r: (r[2], r[4]))
        for i, r in enumerate(mine):
            need = (float("inf") if r[3] is None else r[3]) if reach == "until" else r[2]
            for p in reversed(mine[:i]):
                if p[3] is None or p[3] >= need:
                    out[r[1]] = p[1]
                    break
    return out


@pytest.mark.parametrize("scopes", [1, 2, 40])
def test_nearest_container_over_blocks(spark, scopes):
    rng = random.Random(scopes)
    rows = []
    for i in range(700):
        start = rng.randrange(3000) * 1.0
        end = None if rng.random() < 0.02 else start + rng.choice([0, 3, 30, 300, 3000]) * rng.random()
        rows.append((f"s{rng.randrange(scopes)}", str(i), start, end, i))
    rows += [("s0", f"n{k}", 4000.0 + k, 9000.0 - k, 1000 + k) for k in range(60)]  # nested over many blocks
    rows += [("s0", f"r{k}", 9500.0 + k, 9600.0 + 2 * k, 2000 + k) for k in range(60)]  # each longer than the one before
    frame = spark.createDataFrame(rows, "scope string, id string, start_ms double, end_ms double, seq long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for scope, given in (("scope", rows), (None, [("", *r[1:]) for r in rows])):
            got = {r.id: r.parent_id for r in causal.containment(frame, scope).collect()}
            assert got == brute_nearest(given, "until")
            got = {r.id: r.parent_id for r in causal.overlap_parents(frame.withColumnRenamed("id", "op_key"), scope).collect()}
            assert got == brute_nearest(given, "start")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nearest_container_of_nothing(spark):
    frame = spark.createDataFrame([], "id string, start_ms double, end_ms double, seq long")
    assert causal.containment(frame).count() == 0


def test_whole_analysis_of_traces(spark):
    rows = []
    for t in range(8):
        slow = 400.0 if t > 5 else 0.0
        rows.append((f"t{t}", "a", None, "web", "GET /", 2, 0.0, 100.0 + slow, False, None))
        rows.append((f"t{t}", "b", "a", "shop", "call", 2, 10.0, 60.0 + slow, False, None))
        rows.append((f"t{t}", "c", "b", "db", "query", 2, 20.0, 50.0 + slow, t > 5, "pool timeout" if t > 5 else None))
    got = distributed.analyse(spark.createDataFrame(rows, schema.SPAN))
    causes = {r["rank"]: r for r in got["causes"].collect()}
    assert causes[1].service == "db" and 0.3 <= causes[1].confidence <= 0.95 and causes[2].confidence is None
    assert got["spans"].count() == 24 and got["nodes"].count() == 3 and {r.place for r in got["recommendations"].collect()} >= {0, 1}


def test_snapshot_history_file(spark, tmp_path):
    from tracequill.sources import files

    record = {"id": "1", "timestamp": 5.0, "label": "x", "beforeName": "a", "afterName": "b", "beforeSize": 1.0, "afterSize": 3.0, "newNodeCount": 2, "removedNodeCount": 0, "retainedSizeDelta": 2.0, "growthRate": None, "flagged": True}
    (tmp_path / "h.json").write_text(json.dumps([record, record | {"id": None}, {k: v for k, v in record.items() if k != "flagged"}]))
    (row,) = files.read_snapshot_history(spark, str(tmp_path / "h.json")).collect()
    assert (row.id, row.ts_ms, row.delta, row.growth_rate, row.flagged) == ("1", 5.0, 2.0, None, True)


def test_collector_lines_are_taken_apart_once(spark):
    from tracequill.operators import memory

    lines = [(1, "[1:0x1] 44 ms: Mark-sweep 10.5 (600.0) -> 4.0 (600.0) MB, 2.5 / 0.5 ms (x)"), (2, "none"), (3, None), (4, "[1:0x1]\t45 ms: Scavenge 1.0 (2.0)->0.5 (2.0) MB, 1.0/0.0 ms")]
    out = memory.gc_entries(spark.createDataFrame(lines, "seq long, line string"))
    assert [(r.seq, r.ts_ms, r.type, r.heap_before, r.heap_after, r.pause_ms, r.pause_type) for r in out.orderBy("seq").collect()] == [
        (1, 44, "Mark-sweep", int(10.5 * 2**20), 4 * 2**20, 3.0, "major"), (4, 45, "Scavenge", 2**20, 2**19, 1.0, "minor")]
    read = spark.range(5).selectExpr("id AS seq", "concat(id, ' ms: x') AS line")
    assert memory.gc_entries(read)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
