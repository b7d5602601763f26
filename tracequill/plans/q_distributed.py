"""Queries over distributed spans: trees, skew, topology, root causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core
from ..operators import distributed as dist
from .bridge import OPS, SPAN, spans, trace_events
from .stages import saved

LINKED = "WITH RECURSIVE " + SPAN + """,
linked AS (
  SELECT s.* EXCLUDE (parent_span_id), p.span_id AS parent_span_id, greatest(s.end_ms - s.start_ms, 0) AS duration_ms
  FROM span s LEFT JOIN span p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.span_id <> s.span_id
),
skew AS (
  SELECT trace_id, span_id, start_ms AS adj, 0 AS depth FROM linked WHERE parent_span_id IS NULL
  UNION ALL SELECT l.trace_id, l.span_id, greatest(l.start_ms, k.adj + 0.001), k.depth + 1 FROM linked l JOIN skew k ON l.trace_id = k.trace_id AND l.parent_span_id = k.span_id
),
node AS (
  SELECT service, count(*) AS calls, count(DISTINCT trace_id) AS traces, round(avg(duration_ms), 6) AS avg_ms, round(quantile_disc(duration_ms, 0.5), 6) AS p50_ms,
    round(quantile_disc(duration_ms, 0.95), 6) AS p95_ms, round(quantile_disc(duration_ms, 0.99), 6) AS p99_ms, round(max(duration_ms), 6) AS max_ms,
    count(*) FILTER (WHERE error) AS errors, round(count(*) FILTER (WHERE error)::DOUBLE / count(*), 9) AS error_rate
  FROM linked GROUP BY service
),
median AS (SELECT list_sort(list(p95_ms))[(count(*) // 2 + 1)::INT] AS median_p95 FROM node WHERE p95_ms > 0),
call AS (
  SELECT p.service AS source, c.service AS target, c.duration_ms, c.error, c.kind IN (4, 5) OR p.kind IN (4, 5) AS waits
  FROM linked c JOIN linked p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY CASE WHEN parent_span_id IS NULL THEN 0 ELSE -duration_ms END, start_ms, span_id) AS r FROM linked
),
path AS (
  SELECT trace_id, span_id, service, 0 AS depth FROM ranked WHERE parent_span_id IS NULL AND r = 1
  UNION ALL SELECT n.trace_id, n.span_id, n.service, p.depth + 1 FROM ranked n JOIN path p ON n.trace_id = p.trace_id AND n.parent_span_id = p.span_id WHERE n.r = 1
),
base AS (SELECT service, quantile_disc(duration_ms, 0.25) AS base FROM linked GROUP BY service),
inside AS (SELECT trace_id, parent_span_id AS span_id, sum(duration_ms) AS inside FROM linked WHERE parent_span_id IS NOT NULL GROUP BY 1, 2),
scored AS (
  SELECT l.service, base, least(greatest(CASE WHEN base > 0 THEN least(greatest((duration_ms / base - 1) / 2, 0), 1) WHEN duration_ms > 0 THEN 1 ELSE 0 END
      + CASE WHEN error THEN 0.15::DOUBLE ELSE 0 END, 0), 1) AS m,
    CASE WHEN base > 0 AND duration_ms > base * 1.5 THEN least(greatest(greatest(duration_ms - coalesce(inside, 0), 0) / greatest(base, 1), 0), 1) WHEN base = 0 AND error THEN 0.6 ELSE 0 END AS u
  FROM linked l JOIN base USING (service) LEFT JOIN inside i ON i.trace_id = l.trace_id AND i.span_id = l.span_id
)"""


def _linked(spark, d):
    return dist.link_spans(spans(spark, d))


def span_tree(spark, d):
    out = dist.correct_skew(_linked(spark, d))
    return out.select("trace_id", "span_id", "parent_span_id", "depth", F.round(F.col("adjusted_start_ms") - F.col("start_ms"), 3).alias("shift_ms"))


def service_nodes(spark, d):
    return dist.service_nodes(_linked(spark, d))


def service_edges(spark, d):
    return dist.service_edges(_linked(spark, d))


def service_anomalies(spark, d):
    return dist.anomalies(dist.correct_skew(_linked(spark, d)))


def critical_paths(spark, d):
    return dist.critical_paths(_linked(spark, d))


def criticality(spark, d):
    return dist.criticality(dist.critical_paths(_linked(spark, d)))


def blame(spark, d):
    linked = _linked(spark, d)
    return dist.blame(dist.service_edges(linked), dist.anomalies(dist.correct_skew(linked)))


def root_causes(spark, d):
    linked = _linked(spark, d)
    found = dist.anomalies(dist.correct_skew(linked))
    return dist.root_causes(dist.service_nodes(linked), found, dist.criticality(dist.critical_paths(linked)), dist.blame(dist.service_edges(linked), found))


def cascade(spark, d):
    linked = _linked(spark, d)
    found = dist.anomalies(dist.correct_skew(linked))
    return dist.cascade(dist.service_edges(linked), dist.service_nodes(linked), found, "error").withColumn("impact", F.round("impact", 6))


def _ranked(spark, d):
    linked = _linked(spark, d)
    found = dist.anomalies(dist.correct_skew(linked))
    nodes = saved(dist.service_nodes(linked))
    return nodes, dist.root_causes(nodes, found, dist.criticality(dist.critical_paths(linked)), dist.blame(dist.service_edges(linked), found))


def cause_evidence(spark, d):
    nodes, ranked = _ranked(spark, d)
    return dist.confidence(dist.explained(ranked, nodes), spans(spark, d)).select("service", "rank", "confidence", F.array_join("evidence", " | ").alias("evidence"))


def recommendations(spark, d):
    _, ranked = _ranked(spark, d)
    s = spans(spark, d)
    some = s.withColumn("error_message", F.when(F.col("span_id").endswith("7"), F.concat(F.lit("Pool Timeout "), "error_message")).otherwise(F.col("error_message")))
    return dist.recommendations(ranked, some)


def operation_spans(spark, d):
    """Operations whose contexts name a trace (the user), a parent and a service, as spans."""
    context = F.to_json(F.struct(F.col("user_id").cast("string").alias("traceId"), F.concat(F.lit("p"), "operation_id").alias("parentSpanId"), F.substring("channel", 5, 99).alias("serviceName"), F.lit(2).alias("kind")))
    events = trace_events(spark, d).withColumn("context_json", F.when(F.col("user_id") % 3 > 0, context).otherwise(F.lit("{}")))
    rows = dist.operation_spans(core.pair_operations(events), events)
    return rows.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", *(F.round(c, 3).alias(c) for c in ("start_ms", "end_ms")), "error", "error_message")


QUERIES = {
    f.__name__: f
    for f in (span_tree, service_nodes, service_edges, service_anomalies, critical_paths, criticality, blame, root_causes, cascade, cause_evidence, recommendations, operation_spans)
}

_STEPS = ",\n".join(
    f"b{k} AS (SELECT s.service, (1 - 0.85::DOUBLE) * s.w + 0.85::DOUBLE * coalesce((SELECT sum(b.x / greatest(1, cn.n)) FROM ce JOIN b{k - 1} b ON b.service = ce.source JOIN cn ON cn.service = ce.source WHERE ce.target = s.service), 0) AS x FROM seed s)"
    for k in range(1, 25)
)
_CAUSE = f"""{LINKED}, mag AS (SELECT service, round(any_value(base), 6) AS baseline_ms, round(avg(m), 6) AS magnitude, round(avg(u), 6) AS unexplained FROM scored GROUP BY service),
ce AS (SELECT DISTINCT source, target FROM call), cn AS (SELECT m.service, count(ce.source) AS n FROM mag m LEFT JOIN ce ON ce.target = m.service GROUP BY 1),
seed AS (SELECT service, CASE WHEN sum(magnitude) OVER () > 0 THEN magnitude / sum(magnitude) OVER () ELSE magnitude END AS w FROM mag),
b0 AS (SELECT service, 0::DOUBLE AS x FROM seed),
{_STEPS},
bl AS (SELECT service, round(CASE WHEN max(x) OVER () > 0 THEN x / max(x) OVER () ELSE x END, 9) AS blame FROM b24),
cr AS (SELECT service, round(count(DISTINCT trace_id)::DOUBLE / (SELECT count(DISTINCT trace_id) FROM path), 9) AS criticality FROM path GROUP BY service),
nd AS (SELECT n.*, median_p95, CASE WHEN error_rate >= 0.01 THEN 'error' WHEN median_p95 > 0 AND p95_ms >= 1.5 * median_p95 THEN 'latency' ELSE 'throughput' END AS signal FROM node n, median),
rk AS (SELECT service, signal, magnitude, unexplained, coalesce(criticality, 0) AS criticality, coalesce(blame, 0) AS blame,
  round(0.28 * unexplained + 0.2 * least(1, greatest(0, magnitude)) + 0.15 * coalesce(criticality, 0) + 0.17 * least(1, error_rate * 5) + 0.2 * coalesce(blame, 0), 6) AS score
  FROM nd JOIN mag USING (service) LEFT JOIN cr USING (service) LEFT JOIN bl USING (service)),
rkd AS (SELECT *, row_number() OVER (ORDER BY score DESC, service) AS rank FROM rk)"""
_LEVELS = "v0 AS (SELECT 'error' AS service, 0 AS depth, 1 AS pos), w0 AS (SELECT * FROM v0)" + "".join(
    f""", v{k} AS (SELECT c.source AS service, {k} AS depth, row_number() OVER (ORDER BY min(p.pos), c.source) AS pos FROM ce c JOIN v{k - 1} p ON p.service = c.target JOIN mag m ON m.service = c.source
  WHERE m.magnitude > 0.12 AND c.source NOT IN (SELECT service FROM w{k - 1}) GROUP BY c.source), w{k} AS (SELECT * FROM w{k - 1} UNION ALL SELECT * FROM v{k})"""
    for k in range(1, 5)
)

ORACLE_SQL = {
    "operation_spans": f"""WITH {OPS}, m AS (SELECT operation_id, max(error_message) AS error_message FROM ev WHERE event_type = 'error' GROUP BY 1)
SELECT CASE WHEN user_id % 3 > 0 THEN user_id::VARCHAR ELSE 'untraced' END AS trace_id, op_key AS span_id, CASE WHEN user_id % 3 > 0 THEN 'p' || op_key END AS parent_span_id, CASE WHEN user_id % 3 > 0 THEN channel[5:] ELSE 'unknown' END AS service, channel AS name,
  CASE WHEN user_id % 3 > 0 THEN 2 END AS kind, round(start_ms, 3) AS start_ms, round(coalesce(end_ms, start_ms + duration_ms), 3) AS end_ms, status = 'error' AS error, error_message FROM op LEFT JOIN m ON m.operation_id = op_key""",
    "span_tree": f"{LINKED} SELECT l.trace_id, l.span_id, l.parent_span_id, k.depth::BIGINT AS depth, round(k.adj - l.start_ms, 3) AS shift_ms FROM linked l JOIN skew k ON k.trace_id = l.trace_id AND k.span_id = l.span_id",
    "service_nodes": f"""{LINKED} SELECT n.*, median_p95,
  CASE WHEN error_rate >= 0.05 OR (error_rate >= 0.01 AND median_p95 > 0 AND p95_ms >= 3 * median_p95) THEN 'faulty' WHEN error_rate >= 0.01 THEN 'warning'
    WHEN median_p95 > 0 AND p95_ms >= 3 * median_p95 THEN 'faulty' WHEN median_p95 > 0 AND p95_ms >= 1.5 * median_p95 THEN 'warning' ELSE 'healthy' END AS health,
  CASE WHEN error_rate >= 0.01 THEN 'error' WHEN median_p95 > 0 AND p95_ms >= 1.5 * median_p95 THEN 'latency' ELSE 'throughput' END AS signal FROM node n, median""",
    "service_edges": f"""{LINKED} SELECT source, target, count(*) AS calls, count(*) FILTER (WHERE error) AS errors, round(avg(duration_ms), 6) AS avg_ms,
  round(quantile_disc(duration_ms, 0.95), 6) AS p95_ms, CASE WHEN bool_or(waits) THEN 'async' ELSE 'sync' END AS kind FROM call GROUP BY 1, 2""",
    "service_anomalies": f"{LINKED} SELECT service, round(any_value(base), 6) AS baseline_ms, round(avg(m), 6) AS magnitude, round(avg(u), 6) AS unexplained FROM scored GROUP BY service",
    "critical_paths": f"{LINKED} SELECT trace_id, span_id, service, depth::BIGINT AS depth FROM path",
    "criticality": f"{LINKED} SELECT service, round(count(DISTINCT trace_id)::DOUBLE / (SELECT count(DISTINCT trace_id) FROM path), 9) AS criticality FROM path GROUP BY service",
    "blame": f"{_CAUSE} SELECT service, blame FROM bl",
    "root_causes": f"{_CAUSE} SELECT service, rank::INT AS rank, score, signal, magnitude, unexplained, criticality, blame FROM rkd",
    "cascade": f"""{_CAUSE}, {_LEVELS}, st AS (SELECT *, row_number() OVER (ORDER BY depth, pos) AS step FROM w4)
SELECT step::INT AS step, service, depth, signal, round(least(1, greatest(0, magnitude)), 6) AS impact, CASE WHEN error_rate > 0 THEN printf('error rate %.1f%% (%d/%d calls)', round(error_rate * 100, 1), errors, calls)
  WHEN signal = 'latency' THEN printf('latency up to %.0fms (%d%% above baseline)', round(p95_ms), round(magnitude * 100)::INT) ELSE printf('throughput pressure / queue backlog (%d%% of normal load)', round(magnitude * 100)::INT) END AS symptom
FROM st JOIN nd USING (service) JOIN mag USING (service) WHERE step <= 6""",
    "cause_evidence": f"""{_CAUSE}, c AS (SELECT *, score - lead(score, 1, 0) OVER (ORDER BY rank) AS ahead FROM rkd), t AS (SELECT count(DISTINCT trace_id) AS n FROM span),
e AS (SELECT *, list_filter([CASE WHEN error_rate > 0 THEN printf('%d/%d calls errored (%.1f%%)', errors, calls, round(error_rate * 100, 1)) END,
  printf('p95 %.0fms', round(p95_ms)) || CASE WHEN error_rate = 0 THEN '' ELSE printf(', avg %.0fms', round(avg_ms)) END, CASE WHEN unexplained > 0.35 THEN printf('slow work not explained by child calls (self-time anomaly %d%%)', round(unexplained * 100)::INT) END,
  CASE WHEN magnitude > 0.4 THEN printf('latency %d%% above its own baseline', round(magnitude * 100)::INT) END, CASE WHEN criticality > 0.3 THEN printf('on critical path in %d%% of traces', round(criticality * 100)::INT) END,
  CASE WHEN blame > 0.4 THEN printf('implicated by %d%% of downstream impact', round(blame * 100)::INT) END], lambda x: x IS NOT NULL) AS ev FROM c JOIN nd USING (service, signal))
SELECT service, rank::INT AS rank, CASE WHEN rank = 1 THEN round(greatest(0.3, least(0.95, 0.45::DOUBLE + 0.3 * least(1, greatest(0, ahead)) + 0.15 * least(1, t.n / 5.0::DOUBLE) + 0.1 * least(1, len(ev) / 3.0::DOUBLE))), 6) END AS confidence, array_to_string(ev, ' | ') AS evidence FROM e, t""",
    "recommendations": f"""{_CAUSE}, m AS (SELECT CASE WHEN span_id LIKE '%7' THEN 'pool timeout ' ELSE '' END || lower(error_message) AS m FROM span WHERE error)
SELECT 0 AS place, 'Raise client/server timeout bounds and re-check the dependency SLO for the slowest callee.' AS text WHERE EXISTS (SELECT 1 FROM m WHERE contains(m, 'timeout'))
UNION ALL SELECT 1, 'Connection/thread pool exhaustion detected — increase pool size or add wait-queue limits on the top-ranked service.' WHERE EXISTS (SELECT 1 FROM m WHERE contains(m, 'pool'))
UNION ALL SELECT 10, CASE signal WHEN 'latency' THEN 'Optimize the slowest path in ' || service || ': add caching, reduce N+1 calls, or move work off the critical path.' ELSE 'Triage errors in ' || service || ': check its dependencies and error handling before touching downstream services.' END FROM rkd WHERE rank = 1 AND signal IN ('latency', 'error')
UNION ALL SELECT 11, 'Treat downstream services (' || (SELECT string_agg(service, ', ' ORDER BY rank) FROM rkd WHERE rank BETWEEN 2 AND 4) || ') as effects until ' || service || ' is resolved.' FROM rkd WHERE rank = 1""",
}
