"""Queries over loading, heaps, live feeds, source maps, texts, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import severity
from ..operators import core, heap, live, loading
from ..sinks import exports, reports
from ..sources import binary, sourcemap
from . import q_core, q_memory
from .bridge import EV, OPS, raw, spans, trace_events

# ---- loading: one document per user, in one of four shapes by the user's number


def documents(spark, d):
    """Documents of native events, flat spans, processes with spans, and what must be refused."""
    e = raw(spark, d).withColumn("ms", F.round("ts_ms")).withColumn("u", F.col("user_id") % 5)
    bad = F.col("event_type") == "error"
    nano = lambda c: F.format_string("%.0f", c * 1000000)
    s = lambda c: c.cast("string")
    event = F.struct(F.concat(F.lit("app:"), "event_type").alias("channel"), F.lit("start").alias("eventType"), F.col("ms").alias("timestamp"), s(F.col("event_id")).alias("operationId"), F.struct(F.col("value").alias("v")).alias("context"))
    value = F.struct(F.when(F.col("event_id") % 2 == 0, "even").alias("stringValue"), F.when(F.col("event_id") % 2 == 1, s(F.col("event_id"))).alias("intValue"))
    attributes = F.array(F.struct(F.lit("k").alias("key"), value.alias("value")))
    status = F.struct(F.when(bad, 2).otherwise(1).alias("code"), F.when(bad, "broken").alias("message"))
    flat = F.struct(s(F.col("user_id")).alias("traceId"), s(F.col("event_id")).alias("spanId"), F.concat(F.lit("op "), "event_type").alias("name"), F.lit(2).alias("kind"), nano(F.col("ms")).alias("startTimeUnixNano"), nano(F.col("ms") + 1000).alias("endTimeUnixNano"), attributes.alias("attributes"), status.alias("status"))
    process = F.struct(F.when(F.col("event_id") % 3 > 0, s(F.col("event_id"))).alias("spanId"), F.concat(F.lit("op "), "event_type").alias("operationName"), F.format_string("%.0f", F.col("ms") * 1000).alias("startTime"), F.lit(2500.0).alias("duration"), status.alias("status"))
    g = e.groupBy("user_id", "u").agg(*(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x")))).alias(n) for n, x in (("native", event), ("flat", flat), ("process", process))))
    items = lambda n: F.transform(n, lambda x: x["x"])
    out = (
        F.when(F.col("u") == 0, F.concat(F.lit("﻿"), F.to_json(items("native")))).when(F.col("u") == 1, F.to_json(F.struct(items("flat").alias("spans"))))
        .when(F.col("u") == 2, F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("svc").alias("serviceName")).alias("process"), items("process").alias("spans"))).alias("data"))))
        .when(F.col("u") == 3, F.when(F.col("user_id") % 2 == 0, '{"format": "ndv"}').otherwise("[]")).otherwise(F.when(F.col("user_id") % 2 == 0, "{broken").otherwise('[{"a": 1}]'))
    )
    return g.select(F.format_string("%09d.json", "user_id").alias("file"), out.alias("text"))


def document_formats(spark, d):
    return loading.formats(documents(spark, d))


def loaded_events(spark, d):
    rows = loading.load(documents(spark, d), strict=False)
    at = lambda k: F.get_json_object("context_json", f"$.{k}")
    return rows.select(
        "file", "format", "channel", "event_type", F.round("ts_ms", 2).alias("ts_ms"), "operation_id", "duration_ms", "error_message", at("k").alias("k"), at("traceId").alias("trace_id"), at("kind").alias("kind"), at("serviceName").alias("service"),
        at("statusMessage").alias("said"), F.col("seq").bitwiseAND((1 << 40) - 1).alias("place"),
    ).withColumn("operation_id", F.when(F.col("operation_id").startswith("otel:"), "made").otherwise(F.col("operation_id")))


# ---- heaps and profiles


def _heap(spark, d):
    h = q_memory._heap(spark, d)
    kind = F.when(F.col("type") == "closure", "concatenated-string").otherwise(F.col("type"))
    return h.withColumn("type", kind).withColumn("name", F.when(F.col("id") % 100 == 7, "ArrayBuffer").otherwise(F.repeat("name", 12)))


def heap_string_totals(spark, d):
    h = _heap(spark, d)
    return heap.string_totals(h, h.select("name").distinct())


def heap_top_strings(spark, d):
    return heap.top_strings(_heap(spark, d))


def heap_external(spark, d):
    return heap.external_memory(_heap(spark, d))


def heap_largest_changes(spark, d):
    changes = heap.diff(q_memory._heap(spark, d, False), q_memory._heap(spark, d, True))
    all_ = heap.largest_changes(changes).limit(15).select("name", "type", "size_delta", F.lit("any").alias("list"))
    return all_.unionByName(heap.largest_changes(changes, "removed").limit(5).select("name", "type", "size_delta", F.lit("removed").alias("list")))


def _profile(spark, d):
    s = spans(spark, d)
    return s.select(F.col("span_id").alias("id"), F.col("parent_span_id").alias("parent_id"), F.col("service").alias("function")), s.filter("CAST(span_id AS LONG) % 9 > 0").select(F.col("span_id").alias("node_id"), F.round((F.col("end_ms") - F.col("start_ms")) * 1000).cast("long").alias("delta_us"))


def hot_functions(spark, d):
    return heap.hot_functions(heap.cpu_functions(*_profile(spark, d))).select("id", "total_ms", "self_ms")


def flame_graph(spark, d):
    return heap.flame(*_profile(spark, d)).select("id", "function", "depth", "value_ms")


# ---- live feeds and displays


def live_channel_counts(spark, d):
    return live.channel_counts(trace_events(spark, d), 3)


def live_rates(spark, d):
    return live.rates(trace_events(spark, d), "user_id").select("series", F.round("error_rate", 9).alias("error_rate"), "event_rate")


def live_alerts(spark, d):
    e = trace_events(spark, d)
    samples = e.select(F.col("channel").alias("series"), "ts_ms", F.floor(F.col("duration_ms") * 1e6).alias("heap_used"), F.lit(5e8).alias("heap_total"), F.lit(0.0).alias("external"), F.lit(0.0).alias("rss"), "seq").filter("seq % 2 = 0")
    rules = spark.createDataFrame([("a", "errorRate", "greaterThan", 5.0, "warning", True), ("b", "eventRate", "greaterThan", 1.0, "info", True)], "id string, metric string, operator string, threshold double, level string, enabled boolean")
    return live.live_alerts(samples, e, "channel", rules).select("series", "id", "metric", "value", "threshold", "level", "message")


def trailing_frame(spark, d):
    return live.trailing(trace_events(spark, d), "user_id", 6 * 3600 * 1000.0).select("user_id", "seq")


def last_events(spark, d):
    e = trace_events(spark, d).filter("event_type = 'start'")
    return live.last_rows(e, "user_id", 4, "seq").select("user_id", "seq")


def reassembled_chunks(spark, d):
    e = raw(spark, d)
    chunks = e.select((F.col("event_id") / 10).cast("long").alias("transfer"), (F.col("event_id") % 10).cast("int").alias("idx"), F.lit(10).alias("total"), F.concat(F.col("event_type"), F.lit(";")).alias("data"))
    return live.reassemble(chunks.unionByName(chunks.filter("idx = 3")).filter("transfer % 17 <> 0 OR idx <> 5"))


def feed_messages(spark, d):
    e = raw(spark, d)
    inner = F.format_string('{"channel": "c", "eventType": "%s", "timestamp": %d}', "event_type", "event_id")
    json = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type": "Event", "data": '), inner, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"kind": "event", "payload": '), inner, F.lit("}"))).otherwise(F.format_string('{"type": "memory", "heapUsed": %d, "ts": 5}', "event_id"))
    return live.messages(e.select(json.alias("json")))


def event_page(spark, d):
    return live.page(trace_events(spark, d), ["ts_ms", "seq"], 100, 50).select("seq", "channel")


def index_by_channel(spark, d):
    return live.by_channel(trace_events(spark, d)).select("channel", F.size("seqs").alias("n"), F.element_at("seqs", 1).alias("first"), F.element_at("seqs", -1).alias("last"))


def index_by_operation(spark, d):
    return live.by_operation(trace_events(spark, d)).select("operation_id", F.array_join("seqs", ",").alias("seqs"))


def all_channel_stats(spark, d):
    e = trace_events(spark, d)
    stats = core.channel_stats(core.pair_operations(e.filter("channel <> 'app:view'")))
    return live.stats_of_all_channels(stats, e).select("channel", "total", "error", F.round("avg_ms", 6).alias("avg_ms"))


def displayed_events(spark, d):
    return live.kept_events(trace_events(spark, d), 500).select("seq")


def issue_totals(spark, d):
    return live.severity_totals(core.validate(q_core._odd(spark, d)))


def async_issues(spark, d):
    """Asynchronous records are counted apart: every third event starts one, every fifth ends one."""
    e = trace_events(spark, d)
    kind = F.when(F.col("seq") % 3 == 0, "asyncStart").when(F.col("seq") % 5 == 0, "asyncEnd").otherwise(F.col("event_type"))
    rows = e.withColumn("event_type", kind).withColumn("operation_id", F.concat(F.lit("job:"), F.floor(F.col("seq") / 6)))
    return core.validate(rows).filter("category = 'pairing'")


def prompt_lines(spark, d):
    ops = core.pair_operations(trace_events(spark, d))
    s = ops.select(F.col("op_key").alias("id"), F.concat(F.floor(F.col("op_key").cast("long") / 4) * 4, F.lit("")).alias("parent_id"), "channel", "duration_ms", "status")
    return live.prompt_lines(s, 30)


# ---- texts


def formatted_values(spark, d):
    e = raw(spark, d)
    v = F.col("value")
    return e.select(
        "event_id", text.bytes_text(F.pow(v, F.lit(3.0))).alias("size"), text.duration_text(v * v / 50).alias("duration"), text.percent_text(v / 499.7).alias("percent"), text.time_text(F.round("ts_ms")).alias("time"),
        text.shortened(F.repeat("event_type", (F.col("event_id") % 30).cast("int")), 40).alias("short"), severity(v / 500).alias("severity"),
    )


# ---- source maps


def _map(spark):
    """A map of three lines: positions 0, 4 and 9 of the first, 2 of the third, and one without a source."""
    json = '{"version": 3, "sources": ["a.ts", "b.ts"], "names": ["run"], "sourceRoot": "src", "mappings": "AAAA,IAEIA,KCCC;;EADH,G"}'
    return sourcemap.mappings(spark.createDataFrame([("m", json)], "map_id string, json string"))


def _bundles(spark, d):
    """Maps made of the events: a map a type, seven compiled lines each."""
    e = F.col("event_id")
    rows = raw(spark, d).select(
        F.col("event_type").alias("map_id"), (e % 7 + 1).cast("int").alias("gen_line"), (e / 7).cast("int").alias("gen_col"), F.concat(F.lit("src/"), F.col("user_id") % 5, F.lit(".ts")).alias("source"),
        (e % 90 + 1).cast("int").alias("line"), (e % 40).cast("int").alias("col"), F.when(e % 3 == 0, F.concat(F.lit("n"), e % 11)).alias("name"),
    )
    return sourcemap.pack(rows)


def source_mappings(spark, d):
    return sourcemap.mappings(_bundles(spark, d))


def minified_frames(spark, d):
    """A frame an event, resolved in one bundle of one line with a segment an event."""
    e = F.col("event_id")
    rows = raw(spark, d)
    bundle = sourcemap.pack(rows.select(F.lit("bundle").alias("map_id"), F.lit(1).alias("gen_line"), (e * 3 + 5).cast("int").alias("gen_col"), F.concat(F.lit("src/"), F.col("user_id") % 5, F.lit(".ts")).alias("source"), (e % 90 + 1).cast("int").alias("line"), (e % 40).cast("int").alias("col"), F.lit(None).cast("string").alias("name")))
    frames = rows.select("event_id", F.lit("bundle").alias("map_id"), F.lit(1).alias("line"), (e * 7919 % 30011).cast("int").alias("col"))
    return sourcemap.resolve(frames, sourcemap.mappings(bundle), ["event_id"]).select("event_id", "col", "original.source", F.col("original.line").alias("src_line"), F.col("original.col").alias("src_col"))


def resolved_frames(spark, d):
    e = raw(spark, d).select("event_id", F.lit("m").alias("map_id"), (F.col("event_id") % 4 + 1).cast("int").alias("line"), (F.col("user_id") % 12).cast("int").alias("col"))
    return sourcemap.resolve(e, _map(spark), ["event_id"]).select("event_id", "original.source", F.col("original.line").alias("src_line"), F.col("original.col").alias("src_col"), "original.name")


def compiled_lines(spark, d):
    rows = sourcemap.mappings(_bundles(spark, d))
    places = raw(spark, d).select(F.col("event_type").alias("map_id"), (F.col("event_id") % 9 + 1).cast("int").alias("gen_line")).distinct()
    return sourcemap.generated_lines(rows, "src/2.ts", 4).unionByName(sourcemap.covered(places, rows))


def frame_kinds(spark, d):
    e = raw(spark, d)
    pick = F.element_at(F.array(*(F.lit(x) for x in ("internal/timers.js", "node:fs", "/app/node_modules/pg/node:x.js", "/app/main.js", "[eval]", "", "native array.js"))), (F.col("event_id") % 7 + 1).cast("int"))
    name = F.when(F.col("event_id") % 5 == 0, "node::Run").when(F.col("event_id") % 5 == 1, "* inner *").otherwise("load")
    return e.select("event_id", sourcemap.is_runtime(pick).alias("runtime"), sourcemap.is_native(pick, name).alias("native"))


# ---- reports and exports


def report_findings(spark, d):
    stats = core.channel_stats(core.pair_operations(trace_events(spark, d)))
    return reports.key_findings(stats.withColumnRenamed("error", "errors"))


def squeezed_reports(spark, d):
    """Documents through the text of a link and back."""
    e = raw(spark, d).select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"))
    return e.select("event_id", reports.unsqueeze(reports.squeeze("json")).alias("json"))


def binary_round_trip(spark, d):
    """Events of each user written as a binary trace and read again."""
    e = trace_events(spark, d)
    back = binary.decoded(binary.encoded(e, "user_id"), "user_id")
    return back.select("user_id", "pos", "channel", "event_type", "ts_ms", "duration_ms", "operation_id", "error_message", "context_json")


def exported_spans(spark, d):
    rows = exports.event_spans(trace_events(spark, d))
    return rows.select("seq", "traceId", "spanId", "parentSpanId", "name", "startTimeUnixNano", "endTimeUnixNano", F.col("status.code").alias("code"), F.col("status.message").alias("message"), F.size("attributes").alias("n_attributes"))


def export_round_trip(spark, d):
    """Each user's events exported as spans, and the export loaded again: two events a span."""
    docs = exports.exports(trace_events(spark, d), "user_id").select(F.col("user_id").cast("string").alias("file"), F.col("json").alias("text"))
    return loading.load(docs).groupBy("file", "channel", "event_type").agg(F.count("*").alias("n"), F.sum(F.round("ts_ms")).alias("sum_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        document_formats, loaded_events, heap_string_totals, heap_top_strings, heap_external, heap_largest_changes, hot_functions, flame_graph, live_channel_counts, live_rates, live_alerts,
        trailing_frame, last_events, reassembled_chunks, feed_messages, event_page, index_by_channel, index_by_operation, all_channel_stats, displayed_events, issue_totals, async_issues, prompt_lines,
        formatted_values, source_mappings, minified_frames, resolved_frames, compiled_lines, frame_kinds, report_findings, squeezed_reports, binary_round_trip, exported_spans, export_round_trip,
    )
}

_DOC = """doc AS (SELECT *, user_id % 5 AS u, round(epoch_us(ts)::DOUBLE / 1000) AS ms, format('{:09d}.json', user_id) AS file, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"""
_HEAP = q_memory.HEAP + """, hp AS (SELECT id, CASE WHEN id % 100 = 7 THEN 'ArrayBuffer' ELSE repeat(name, 12) END AS name, CASE type WHEN 'closure' THEN 'concatenated-string' ELSE type END AS type, self_size, retained_size FROM heap)"""
_MAPPED = "(VALUES ('m', 1, 0, 'src/a.ts', 1, 0, NULL), ('m', 1, 4, 'src/a.ts', 3, 4, 'run'), ('m', 1, 9, 'src/b.ts', 4, 5, NULL), ('m', 3, 2, 'src/b.ts', 3, 2, NULL)) AS t(map_id, gen_line, gen_col, source, line, col, name)"
_BUNDLES = """(SELECT event_type AS map_id, (event_id % 7 + 1)::INT AS gen_line, (event_id // 7)::INT AS gen_col, 'src/' || user_id % 5 || '.ts' AS source, (event_id % 90 + 1)::INT AS line, (event_id % 40)::INT AS col, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id % 11 END AS name FROM events) AS t"""

ORACLE_SQL = {
    "document_formats": f"""WITH {_DOC} SELECT file, CASE u WHEN 0 THEN 'native' WHEN 1 THEN 'otel' WHEN 2 THEN 'otel' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'ndv' ELSE 'native' END ELSE CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'native' END END AS format,
CASE u WHEN 0 THEN count(*) WHEN 1 THEN count(*) * 2 WHEN 2 THEN count(*) * 2 ELSE 0 END AS events,
CASE WHEN u = 3 AND user_id % 2 = 0 THEN 'This is a binary trace marked as JSON: read it with read_ndv' WHEN u = 4 AND user_id % 2 = 0 THEN 'File is not valid JSON' WHEN u = 4 THEN 'Neither an array of events nor a span export' END AS refused
FROM doc GROUP BY file, u, user_id""",
    "loaded_events": f"""WITH {_DOC} SELECT file, 'native' AS format, 'app:' || event_type AS channel, 'start' AS event_type, ms AS ts_ms, event_id::VARCHAR AS operation_id, NULL::DOUBLE AS duration_ms, NULL AS error_message, NULL AS k, NULL AS trace_id, NULL AS kind, NULL AS service, NULL AS said, i AS place FROM doc WHERE u = 0
UNION ALL SELECT file, 'otel', 'op ' || event_type, CASE half WHEN 0 THEN 'start' ELSE CASE WHEN bad THEN 'error' ELSE 'end' END END, ms + half * 1000, event_id::VARCHAR, 1000, CASE WHEN bad AND half = 1 THEN 'broken' END,
  CASE WHEN event_id % 2 = 0 THEN 'even' ELSE event_id::VARCHAR END, user_id::VARCHAR, '2', NULL, CASE WHEN bad THEN 'broken' END, i * 2 + half FROM doc, (VALUES (0), (1)) h(half) WHERE u = 1
UNION ALL SELECT file, 'otel', 'op ' || event_type, CASE half WHEN 0 THEN 'start' ELSE CASE WHEN bad THEN 'error' ELSE 'end' END END, ms + half * 2.5::DOUBLE, CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR ELSE 'op ' || event_type END, 2.5, CASE WHEN bad AND half = 1 THEN 'broken' END,
  NULL, NULL, NULL, 'svc', CASE WHEN bad THEN 'broken' END, i * 2 + half FROM doc, (VALUES (0), (1)) h(half) WHERE u = 2""",
    "heap_string_totals": f"""WITH {_HEAP} SELECT count(*) AS n, sum(self_size)::BIGINT AS bytes, sum(retained_size)::BIGINT AS retained, (SELECT count(DISTINCT name) FROM hp) AS unique_strings,
round(1 - (SELECT count(DISTINCT name) FROM hp) / count(*)::DOUBLE, 9) AS dedup_ratio FROM hp WHERE type IN ('string', 'concatenated-string')""",
    "heap_top_strings": f"WITH {_HEAP} SELECT id, CASE WHEN length(name) > 100 THEN left(name, 100) || '...' ELSE name END AS value, self_size, retained_size FROM hp WHERE type IN ('string', 'concatenated-string') ORDER BY retained_size DESC, id LIMIT 20",
    "heap_external": f"""WITH {_HEAP}, x AS (SELECT coalesce(sum(retained_size) FILTER (WHERE type = 'concatenated-string'), 0)::BIGINT AS strings, coalesce(sum(retained_size) FILTER (WHERE name = 'ArrayBuffer'), 0)::BIGINT AS array_buffers, sum(self_size)::BIGINT AS own FROM hp)
SELECT strings, array_buffers, strings + array_buffers AS external, round((strings + array_buffers) / (own + strings + array_buffers)::DOUBLE * 100, 6) AS percent FROM x""",
    "heap_largest_changes": f"""WITH {q_memory.HEAP}, g AS (SELECT name, type, sum(CASE WHEN late THEN retained_size ELSE -retained_size END)::BIGINT AS size_delta, bool_and(NOT late) AS removed FROM heap GROUP BY 1, 2)
(SELECT name, type, size_delta, 'any' AS list FROM g ORDER BY abs(size_delta) DESC, name, type LIMIT 15) UNION ALL (SELECT name, type, size_delta, 'removed' FROM g WHERE removed ORDER BY size_delta DESC, name, type LIMIT 5)""",
    "hot_functions": f"""{q_memory._TREE}, s AS (SELECT span_id AS id, round((end_ms - start_ms) * 1000)::BIGINT AS us FROM span WHERE span_id::BIGINT % 9 > 0), t AS (SELECT w.id, sum(s.us) AS total FROM walk w JOIN s ON s.id = w.to_id GROUP BY w.id)
SELECT t.id, round(total / 1000.0::DOUBLE, 6) AS total_ms, round(coalesce(us, 0) / 1000.0::DOUBLE, 6) AS self_ms FROM t LEFT JOIN s USING (id) ORDER BY total_ms DESC, id LIMIT 50""",
    "flame_graph": "WITH RECURSIVE " + q_memory.SPAN + """, n AS (SELECT span_id AS id, parent_span_id AS up, service, span_id::BIGINT % 9 > 0 AS hit, round((end_ms - start_ms) * 1000)::BIGINT AS us FROM span),
w AS (SELECT id, 1 AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM n JOIN w ON n.up = w.id WHERE n.hit)
SELECT id, service AS function, depth::BIGINT AS depth, CASE WHEN hit THEN round(1 / (SELECT count(*) FROM n WHERE hit)::DOUBLE * (SELECT sum(us) / 1000.0::DOUBLE FROM n WHERE hit), 6) ELSE 0 END AS value_ms FROM n JOIN w USING (id)""",
    "live_channel_counts": f"WITH {EV} SELECT channel, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, channel LIMIT 3",
    "live_rates": f"WITH {EV} SELECT user_id AS series, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE * 100, 9) AS error_rate, count(*)::DOUBLE AS event_rate FROM ev GROUP BY 1",
    "live_alerts": f"""WITH {EV}, r AS (SELECT channel AS series, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE * 100, 6) AS e, count(*)::DOUBLE AS n FROM ev GROUP BY 1)
SELECT series, 'a' AS id, 'errorRate' AS metric, e AS value, 5.0::DOUBLE AS threshold, 'warning' AS level, printf('Error Rate > 5.0%%. Current: %.1f%%', e) AS message FROM r WHERE e > 5
UNION ALL SELECT series, 'b', 'eventRate', n, 1, 'info', printf('Event Rate > 1 evt/s. Current: %.0f evt/s', n) FROM r WHERE n > 1""",
    "trailing_frame": f"WITH {EV} SELECT user_id, seq FROM ev QUALIFY ts_ms >= max(ts_ms) OVER (PARTITION BY user_id) - {6 * 3600 * 1000.0}",
    "last_events": f"WITH {EV} SELECT user_id, seq FROM ev WHERE event_type = 'start' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 4",
    "reassembled_chunks": """WITH c AS (SELECT event_id // 10 AS transfer, event_id % 10 AS i, event_type || ';' AS t FROM events WHERE (event_id // 10) % 17 <> 0 OR event_id % 10 <> 5)
SELECT transfer, string_agg(t, '' ORDER BY i) AS content, count(*) = 10 AS complete FROM c GROUP BY 1""",
    "feed_messages": """SELECT CASE WHEN event_id % 3 = 2 THEN 'memory' ELSE 'event' END AS kind, CASE WHEN event_id % 3 < 2 THEN 'c' END AS channel, CASE WHEN event_id % 3 < 2 THEN event_type END AS event_type, CASE WHEN event_id % 3 < 2 THEN event_id::DOUBLE ELSE 5 END AS ts_ms,
CASE WHEN event_id % 3 = 2 THEN event_id::BIGINT END AS heap_used, NULL::VARCHAR AS level, NULL::VARCHAR AS message FROM events""",
    "event_page": f"WITH {EV} SELECT seq, channel FROM ev ORDER BY ts_ms, seq LIMIT 50 OFFSET 100",
    "index_by_channel": f"WITH {EV} SELECT channel, count(*)::INT AS n, min(seq) AS first, max(seq) AS last FROM ev GROUP BY 1",
    "index_by_operation": f"WITH {EV} SELECT operation_id, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM ev GROUP BY 1",
    "all_channel_stats": f"WITH {OPS} SELECT channel, count(*) FILTER (WHERE channel <> 'app:view') AS total, count(*) FILTER (WHERE channel <> 'app:view' AND status = 'error') AS error, round(coalesce(avg(duration_ms) FILTER (WHERE channel <> 'app:view' AND duration_ms > 0), 0), 6) AS avg_ms FROM op GROUP BY 1",
    "displayed_events": f"WITH {EV} SELECT seq FROM ev ORDER BY ts_ms, seq LIMIT 500",
    "issue_totals": f"SELECT severity, sum(n)::BIGINT AS n FROM ({q_core.ORACLE_SQL['validator_issues']}) GROUP BY 1",
    "async_issues": f"""WITH {EV}, k AS (SELECT seq // 6 AS k, CASE WHEN seq % 3 = 0 THEN 'asyncStart' WHEN seq % 5 = 0 THEN 'asyncEnd' ELSE event_type END AS t FROM ev),
g AS (SELECT k, count(*) FILTER (WHERE t = 'start') AS s, count(*) FILTER (WHERE t IN ('end', 'error')) AS e, count(*) FILTER (WHERE t = 'asyncStart') AS a, count(*) FILTER (WHERE t = 'asyncEnd') AS z FROM k GROUP BY 1)
SELECT 'job' AS channel, 'warning' AS severity, 'pairing' AS category, count(*) AS n FROM g WHERE s > 0 AND s <> e HAVING count(*) > 0 UNION ALL SELECT 'job', 'info', 'pairing', count(*) FROM g WHERE a > 0 AND a <> z HAVING count(*) > 0""",
    "prompt_lines": f"""WITH {OPS} SELECT o.op_key AS id, o.channel || ' ' || printf('%.1fms', round(o.duration_ms, 1)) || CASE WHEN p.duration_ms > 0 THEN printf(' (%.1f%% of parent)', round(o.duration_ms / p.duration_ms * 1000) / 10) ELSE '' END || CASE WHEN o.status = 'error' THEN ' [error]' ELSE '' END AS line
FROM op o LEFT JOIN op p ON p.op_key = (o.op_key::BIGINT // 4 * 4)::VARCHAR ORDER BY o.duration_ms DESC, o.op_key LIMIT 30""",
    "formatted_values": """WITH v AS (SELECT *, value * value * value AS b, value * value / 50 AS m, greatest(0, least(3, floor(ln(value * value * value) / ln(1024))))::INT AS k FROM events)
SELECT event_id, printf('%.1f ', round(b / pow(1024, k), 1)) || ['B', 'KB', 'MB', 'GB'][k + 1] AS size, CASE WHEN m < 1 THEN printf('%.0fµs', round(m * 1000)) WHEN m < 1000 THEN printf('%.1fms', round(m, 1)) ELSE printf('%.2fs', round(m / 1000, 2)) END AS duration, printf('%.1f%%', round(value / 499.7::DOUBLE * 100, 1)) AS percent,
  strftime(epoch_ms(round(epoch_us(ts)::DOUBLE / 1000)::BIGINT), '%Y-%m-%d %H:%M:%S.%g') AS time, CASE WHEN length(repeat(event_type, (event_id % 30)::INT)) <= 40 THEN repeat(event_type, (event_id % 30)::INT) ELSE left(repeat(event_type, (event_id % 30)::INT), 40) || '...' END AS short,
  CASE WHEN value / 500 >= 0.7 THEN 'critical' WHEN value / 500 >= 0.35 THEN 'warning' ELSE 'info' END AS severity FROM v""",
    "source_mappings": f"SELECT * FROM {_BUNDLES}",
    "minified_frames": """WITH m AS (SELECT event_id * 3 + 5 AS g, 'src/' || user_id % 5 || '.ts' AS source, (event_id % 90 + 1)::INT AS src_line, (event_id % 40)::INT AS src_col FROM events), f AS (SELECT event_id, (event_id * 7919 % 30011)::INT AS col FROM events)
SELECT event_id, col, source, src_line, src_col FROM f ASOF LEFT JOIN m ON f.col >= m.g""",
    "resolved_frames": f"""WITH e AS (SELECT event_id, event_id % 4 + 1 AS l, user_id % 12 AS c FROM events), f AS (SELECT e.event_id, max(gen_col) AS g, any_value(l) AS l FROM e JOIN {_MAPPED} ON gen_line = l AND gen_col <= c GROUP BY 1)
SELECT e.event_id, t.source, t.line AS src_line, t.col AS src_col, t.name FROM e LEFT JOIN f USING (event_id) LEFT JOIN {_MAPPED} ON t.gen_line = f.l AND t.gen_col = f.g""",
    "compiled_lines": f"""SELECT DISTINCT map_id, gen_line FROM {_BUNDLES} WHERE source = 'src/2.ts' AND line = 4
UNION ALL SELECT DISTINCT event_type, (event_id % 9 + 1)::INT AS gen_line FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.event_id % 7 = e.event_id % 9)""",
    "frame_kinds": """SELECT event_id, event_id % 7 IN (0, 1, 4, 5) AS runtime, event_id % 7 = 6 OR event_id % 5 < 2 AS native FROM events""",
    "report_findings": f"""WITH {OPS}, s AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS e, coalesce(avg(duration_ms) FILTER (WHERE duration_ms > 0), 0) AS a, coalesce(quantile_disc(duration_ms, 0.95) FILTER (WHERE duration_ms > 0), 0) AS p FROM op GROUP BY 1)
SELECT channel, 0 AS place, printf('"%s" avg %.0fms, P95 %.0fms', channel, round(a), round(p)) AS finding FROM s WHERE a > 100 UNION ALL SELECT channel, 1, printf('"%s" has %d errors (%.1f%%)', channel, e, round(e / n::DOUBLE * 100, 1)) FROM s WHERE e > 0""",
    "squeezed_reports": """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json FROM events""",
    "binary_round_trip": f"""WITH {EV} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS pos, channel, event_type, ts_ms, duration_ms, operation_id, 'Error: ' || error_message AS error_message, context_json FROM ev""",
    "exported_spans": f"""WITH {EV} SELECT seq, repeat('0', 32) AS "traceId", rpad(operation_id, 16, '0') AS "spanId", '' AS "parentSpanId", channel AS name, (round(ts_ms)::HUGEINT * 1000000)::VARCHAR AS "startTimeUnixNano", ((round(ts_ms) + round(duration_ms))::HUGEINT * 1000000)::VARCHAR AS "endTimeUnixNano",
CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS code, error_message AS message, 2 AS n_attributes FROM ev""",
    "export_round_trip": f"""WITH {EV}, two AS (SELECT user_id::VARCHAR AS file, channel, 'start' AS event_type, round(ts_ms) AS t FROM ev UNION ALL SELECT user_id::VARCHAR, channel, CASE WHEN event_type = 'error' THEN 'error' ELSE 'end' END, round(ts_ms) + round(duration_ms) FROM ev)
SELECT file, channel, event_type, count(*) AS n, sum(t) AS sum_ms FROM two GROUP BY ALL""",
}
