"""Queries over warnings, noise, context differences, stacks and OTLP exports made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import core, signals
from .bridge import EV, OPS, raw, trace_events

DAY = 86_400_000.0
_KINDS = {"app:click": "gc:minor", "app:view": "timer:tick", "app:signup": "dns:lookup", "app:purchase": "tcp:connect"}


def early_warnings(spark, d):
    return signals.early_warnings(core.pair_operations(trace_events(spark, d)), DAY, factor=1.2)


def local_cause(spark, d):
    ops = core.pair_operations(trace_events(spark, d))
    return signals.local_cause(core.channel_stats(ops), ops)


def noise_regions(spark, d):
    e = trace_events(spark, d).replace(_KINDS, subset="channel")
    return signals.noise_regions(e, "user_id", gap_ms=DAY / 4, pause_ms=100.0)


def context_changes(spark, d):
    e = raw(spark, d)
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id"))
    return signals.context_changes(e.select(F.col("event_id").alias("id"), before.alias("before_json"), F.col("props").alias("after_json")))


def stack_frames(spark, d):
    e = raw(spark, d)
    n = F.col("event_id").cast("string")
    stack = F.concat(F.lit("Error: failed\n    at load (/app/src/"), "event_type", F.lit(".js:"), n, F.lit(":7)\n    at /app/main.js:10:"), n, F.lit("\n    at native"))
    return signals.stack_frames(e.select(F.col("event_id").alias("id"), stack.alias("stack")))


def otlp_events(spark, d):
    e = raw(spark, d)
    nano = lambda c: F.format_string("%.0f", c * 1000000)
    span = F.struct(
        F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit(None).cast("string").alias("parentSpanId"), F.concat(F.lit("op "), "event_type").alias("name"),
        F.lit(2).alias("kind"), nano(F.round(F.col("ts_ms"))).alias("startTimeUnixNano"), nano(F.round(F.col("ts_ms")) + 1000).alias("endTimeUnixNano"), F.struct(F.when(F.col("event_type") == "error", 2).otherwise(0).alias("code")).alias("status"),
    )
    service = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value"))).alias("attributes"))
    one = F.struct(F.array(F.struct(service.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return signals.otlp_events(e.select(F.to_json(one).alias("json"))).select("service", "channel", "operation_id", "event_type", F.round("ts_ms", 0).alias("ts_ms"))


QUERIES = {f.__name__: f for f in (early_warnings, local_cause, noise_regions, context_changes, stack_frames, otlp_events)}

_CASE = "CASE channel " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE channel END"
ORACLE_SQL = {
    "early_warnings": f"""WITH {OPS}, a AS (SELECT *, start_ms + duration_ms AS at_ms FROM op), n AS (SELECT max(at_ms) AS now FROM a),
c AS (SELECT channel, count(*) AS n, quantile_disc(duration_ms, 0.25) AS base, coalesce(avg(duration_ms) FILTER (WHERE at_ms >= now - {DAY}), 0) AS mean,
  count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*) AS ae, coalesce(count(*) FILTER (WHERE status = 'error' AND at_ms >= now - {DAY})::DOUBLE / nullif(count(*) FILTER (WHERE at_ms >= now - {DAY}), 0), 0) AS re FROM a, n GROUP BY channel),
r AS (SELECT *, CASE WHEN base > 0 THEN mean / base ELSE 0 END AS ratio FROM c)
SELECT channel, CASE WHEN ratio >= 3 OR re > ae + 0.1 THEN 'critical' ELSE 'warning' END AS severity, round(base, 6) AS baseline_ms, round(mean, 6) AS window_mean_ms, round(ratio, 6) AS ratio
FROM r WHERE n >= 3 AND (ratio >= 1.2 OR re > ae + 0.02)""",
    "local_cause": f"""WITH {OPS}, s AS (SELECT channel, coalesce(avg(duration_ms) FILTER (WHERE duration_ms > 0), 0) * count(*) AS w FROM op GROUP BY channel)
SELECT (SELECT channel FROM s ORDER BY round(w, 3) DESC, channel DESC LIMIT 1) AS channel, (SELECT op_key FROM op ORDER BY duration_ms DESC, op_key DESC LIMIT 1) AS slowest,
  round(max(duration_ms) / (max(coalesce(end_ms, start_ms + duration_ms)) - min(start_ms)), 9) AS share FROM op""",
    "noise_regions": f"""WITH {EV}, k AS (SELECT user_id, seq, ts_ms, event_type, CASE split_part({_CASE}, ':', 1) WHEN 'gc' THEN 'gc-pause' WHEN 'timer' THEN 'timer-jitter' WHEN 'dns' THEN 'network-dns' WHEN 'tcp' THEN 'tcp-handshake' END AS kind FROM ev),
r AS (SELECT user_id, seq, ts_ms, event_type, kind, row_number() OVER u - 1 AS i, ts_ms - lag(ts_ms) OVER u AS gap, lag(event_type) OVER u AS before, lag(kind) OVER u AS was FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS nn FROM k) WHERE nn > 1 WINDOW u AS (PARTITION BY user_id ORDER BY ts_ms, seq)),
x AS (SELECT *, coalesce(gap > {DAY / 4} AND before IN ('end', 'error'), false) AND coalesce(kind, '') <> 'gc-pause' AS wide,
  sum(CASE WHEN i > 0 AND kind IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS run FROM r),
y AS (SELECT *, CASE WHEN kind IS NOT NULL THEN min(CASE WHEN NOT wide THEN i END) OVER (PARTITION BY user_id, run) END AS from_i FROM x)
SELECT user_id, kind, min(i) AS first, max(i) AS last FROM y WHERE i >= from_i GROUP BY user_id, run, kind HAVING kind <> 'gc-pause' OR max(ts_ms) - min(ts_ms) >= 100
UNION ALL SELECT user_id, 'inter-event-gap', i - 1, i FROM y WHERE wide AND (from_i IS NULL OR i < from_i)""",
    "context_changes": """WITH p AS (SELECT event_id AS id, json_extract_string(lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id), '$.k') AS before, json_extract_string(props, '$.k') AS after FROM events)
SELECT id, 'k' AS key, before, after FROM p WHERE before IS DISTINCT FROM after""",
    "stack_frames": """SELECT event_id AS id, 1 AS place, 'load' AS function, '/app/src/' || event_type || '.js' AS file, event_id::INT AS line, 7 AS col, false AS filtered FROM events
UNION ALL SELECT event_id, 2, '[anonymous]', '/app/main.js', 10, event_id::INT, false FROM events UNION ALL SELECT event_id, 3, '[anonymous]', 'native', NULL, NULL, true FROM events""",
    "otlp_events": """WITH m AS (SELECT *, round(epoch_us(ts)::DOUBLE / 1000) AS ms FROM events)
SELECT event_type AS service, 'op ' || event_type AS channel, event_id::VARCHAR AS operation_id, 'start' AS event_type, ms AS ts_ms FROM m
UNION ALL SELECT event_type, 'op ' || event_type, event_id::VARCHAR, CASE WHEN event_type = 'error' THEN 'error' ELSE 'end' END, ms + 1000 FROM m""",
}
