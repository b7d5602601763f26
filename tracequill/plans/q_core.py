"""Queries over the bridged trace events: pairing, statistics, search, series, comparison, validation, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core
from .bridge import EV, OPS, trace_events

_STATS = """
    count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error,
    count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
    round(coalesce(avg(duration_ms) FILTER (WHERE duration_ms > 0), 0), 6) AS avg_ms,
    round(coalesce(quantile_disc(duration_ms, 0.5) FILTER (WHERE duration_ms > 0), 0), 6) AS p50_ms,
    round(coalesce(quantile_disc(duration_ms, 0.95) FILTER (WHERE duration_ms > 0), 0), 6) AS p95_ms,
    round(coalesce(quantile_disc(duration_ms, 0.99) FILTER (WHERE duration_ms > 0), 0), 6) AS p99_ms,
    round(coalesce(min(duration_ms) FILTER (WHERE duration_ms > 0), 0), 6) AS min_ms,
    round(coalesce(max(duration_ms) FILTER (WHERE duration_ms > 0), 0), 6) AS max_ms"""
#: The moment between the two runs that are compared.
SPLIT_MS = 1705363200000.0
PATTERN, LITERAL = '"k": ?4[0-9]\\}', "APP:SIGNUP"


def _ops(spark, d):
    return core.pair_operations(trace_events(spark, d))


def channel_stats(spark, d):
    return core.channel_stats(_ops(spark, d))


def ranked_stats(spark, d):
    return core.channel_stats(_ops(spark, d), ranked=True)


def operations(spark, d):
    out = _ops(spark, d)
    return out.select("op_key", "channel", *(F.round(c, 3).alias(c) for c in ("start_ms", "end_ms", "duration_ms")), "status")


def trace_summary(spark, d):
    return core.summary(trace_events(spark, d), _ops(spark, d))


def event_validity(spark, d):
    """Some events of an unknown type, without a channel, or with a time that is no number."""
    e = trace_events(spark, d)
    e = e.withColumn("event_type", F.when(F.col("seq") % 7 == 0, "odd").otherwise(F.col("event_type"))).withColumn("channel", F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("channel")))
    return core.validity(e.withColumn("ts_ms", F.when(F.col("seq") % 13 == 0, float("nan")).when(F.col("seq") % 17 != 0, F.col("ts_ms"))))


def channel_filter(spark, d):
    return core.filter_channels(trace_events(spark, d), ["app:click", "app:error"]).select("seq", "channel", "event_type")


def search_regex(spark, d):
    return core.search_text(trace_events(spark, d), PATTERN).select("seq", "channel", "operation_id")


def search_literal(spark, d):
    return core.search_text(trace_events(spark, d), LITERAL, literal=True).groupBy("channel", "event_type").agg(F.count("*").alias("n"))


def search_operations(spark, d):
    events = trace_events(spark, d)
    ops = core.pair_operations(events)
    some = core.filter_by_operation(events, ops, "status = 'success' AND duration_ms BETWEEN 100 AND 200")
    some = some.filter(F.col("ts_ms").between(SPLIT_MS - 864e5 * 5, SPLIT_MS))
    return core.operations_of(ops, some).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"))


def throughput(spark, d):
    return core.throughput(trace_events(spark, d))


def latency_histogram(spark, d):
    return core.latency_histogram(_ops(spark, d))


def series_summary(spark, d):
    return core.series_summary(trace_events(spark, d), _ops(spark, d))


def perf_compare(spark, d):
    ops = _ops(spark, d)
    a, b = ops.filter(F.col("start_ms") < SPLIT_MS), ops.filter((F.col("start_ms") >= SPLIT_MS) & (F.col("channel") != "app:view"))
    return core.compare(core.channel_stats(a), core.channel_stats(b))


def validator_issues(spark, d):
    return core.validate(_odd(spark, d))


def validator_channels(spark, d):
    return core.validate_channels(_odd(spark, d))


def _odd(spark, d):
    """Events some of which break the naming rule or lack what database channels need."""
    e = trace_events(spark, d)
    name = F.when(F.col("channel") == "app:view", "App View").when(F.col("channel") == "app:signup", "pg:signup").otherwise(F.col("channel"))
    return e.withColumn("context_json", F.when((F.col("channel") == "app:signup") & (F.col("duration_ms") > 250), "{}").otherwise(F.col("context_json"))).withColumn("channel", name)


def bottlenecks(spark, d):
    return core.bottlenecks(_ops(spark, d)).select("op_key", "channel", F.round("duration_ms", 3).alias("duration_ms"))


def _calls(spark, d):
    """Operations as children of their user's, on channels that look like queries."""
    ops = _ops(spark, d)
    return ops.select(F.col("user_id").cast("string").alias("parent_id"), F.regexp_replace("channel", "app:", "mysql2:query-").alias("channel"))


def n_plus_one(spark, d):
    return core.n_plus_one(_calls(spark, d), threshold=15)


def gate(spark, d):
    """Views stand for samples of the event loop's delay."""
    e = trace_events(spark, d)
    loops = e.filter("channel = 'app:view'").withColumn("channel", F.lit("node:event-loop")).withColumn("context_json", F.format_string('{"delay": %s}', F.col("duration_ms").cast("string")))
    return core.gate(_ops(spark, d), e.unionByName(loops), core.n_plus_one(_calls(spark, d), threshold=30))


QUERIES = {
    f.__name__: f
    for f in (
        channel_stats, ranked_stats, operations, trace_summary, event_validity, channel_filter, search_regex, search_literal, search_operations, throughput,
        latency_histogram, series_summary, perf_compare, validator_issues, validator_channels, bottlenecks, n_plus_one, gate,
    )
}

_BODY = """'{"channel":"' || channel || '","context":' || coalesce(context_json, '{}') || ',"operationId":"' || coalesce(operation_id, '') || '"}'"""
_ODD = EV + """,
odd AS (
  SELECT seq, CASE WHEN channel = 'app:view' THEN 'App View' WHEN channel = 'app:signup' THEN 'pg:signup' ELSE channel END AS channel,
    event_type, ts_ms, operation_id, CASE WHEN channel = 'app:signup' AND duration_ms > 250 THEN '{}' ELSE context_json END AS context_json
  FROM ev
),
single AS (
  SELECT channel, 'warning' AS severity, 'naming' AS category FROM odd WHERE NOT regexp_matches(channel, '^[a-z0-9_-]+(/[a-z0-9_-]+)?:[a-z0-9_.-]+$')
  UNION ALL SELECT channel, 'warning', 'required-field' FROM odd WHERE (channel LIKE 'mysql2:%' OR channel LIKE 'pg:%' OR channel LIKE 'redis:%') AND len(json_keys(context_json)) = 0
),
keyed AS (
  SELECT operation_id AS key, count(*) FILTER (WHERE event_type = 'start') AS s, count(*) FILTER (WHERE event_type IN ('end', 'error')) AS e FROM odd GROUP BY 1
),
issue AS (
  SELECT channel, severity, category, count(*) AS n FROM (
    FROM single UNION ALL SELECT CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) ELSE 'unknown' END, 'warning', 'pairing' FROM keyed WHERE s > 0 AND s <> e
  ) GROUP BY ALL
)"""
_SIDE = """SELECT channel, total, error, avg_ms, p95_ms FROM (SELECT channel, """ + _STATS + """ FROM op WHERE {} GROUP BY channel)"""
_CHANGE = "round(CASE WHEN coalesce({0}_a, 0) > 0 THEN (coalesce({0}_b, 0) - {0}_a) / {0}_a * 100 ELSE 0 END, 6)"
_CALLS = OPS + """,
call AS (SELECT user_id::VARCHAR AS parent_id, replace(channel, 'app:', 'mysql2:query-') AS channel FROM op),
n1 AS (SELECT parent_id, lower(channel) AS channel, count(*) AS queries FROM call WHERE regexp_matches(channel, '(?i)(mysql|pg|query)') GROUP BY 1, 2)"""

ORACLE_SQL = {
    "channel_stats": f"WITH {OPS} SELECT channel, {_STATS} FROM op GROUP BY channel",
    "ranked_stats": f"WITH {OPS} SELECT channel, {_STATS} FROM op GROUP BY channel",
    "operations": f"WITH {OPS} SELECT op_key, channel, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, round(duration_ms, 3) AS duration_ms, status FROM op",
    "trace_summary": f"""WITH {OPS}
SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT min(ts_ms) FROM ev) AS first_ms, (SELECT max(ts_ms) FROM ev) AS last_ms,
  (SELECT string_agg(DISTINCT channel, ',' ORDER BY channel) FROM ev) AS channels, count(*) AS total_operations,
  round(count(*) FILTER (WHERE status = 'error')::DOUBLE / count(*), 9) AS error_rate FROM op""",
    "event_validity": f"WITH {EV} SELECT count(*) FILTER (WHERE seq % 7 <> 0 AND seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0) AS valid, count(*) FILTER (WHERE seq % 7 = 0 OR seq % 11 = 0 OR seq % 13 = 0 OR seq % 17 = 0) AS invalid FROM ev",
    "channel_filter": f"WITH {EV} SELECT seq, channel, event_type FROM ev WHERE channel IN ('app:click', 'app:error')",
    "search_regex": f"WITH {EV} SELECT seq, channel, operation_id FROM ev WHERE regexp_matches({_BODY}, '(?i){PATTERN}')",
    "search_literal": f"WITH {EV} SELECT channel, event_type, count(*) AS n FROM ev WHERE contains(lower({_BODY}), 'app:signup') GROUP BY 1, 2",
    "search_operations": f"""WITH {OPS},
hit AS (SELECT DISTINCT operation_id FROM ev WHERE operation_id IN (SELECT op_key FROM op WHERE status = 'success' AND duration_ms BETWEEN 100 AND 200)
  AND ts_ms BETWEEN {SPLIT_MS - 864e5 * 5} AND {SPLIT_MS})
SELECT channel, count(*) AS n, round(sum(duration_ms), 3) AS total_ms FROM op WHERE op_key IN (SELECT operation_id FROM hit) GROUP BY channel""",
    "throughput": f"""WITH {EV}, span AS (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1, least(50, ceil(count(*) / 10.0))::INT AS n FROM ev),
grid AS (SELECT unnest(range(n)) AS bucket FROM span),
put AS (SELECT floor((ts_ms - t0) / ((t1 - t0) / n))::INT AS bucket, count(*) AS n FROM ev, span GROUP BY 1)
SELECT grid.bucket::INT AS bucket, t0 + grid.bucket * ((t1 - t0) / span.n) AS from_ms, coalesce(put.n, 0) AS n FROM grid CROSS JOIN span LEFT JOIN put USING (bucket)""",
    "latency_histogram": f"""WITH {OPS}, top AS (SELECT max(duration_ms) AS top FROM op WHERE duration_ms > 0)
SELECT floor(duration_ms / (top / 30))::INT AS bucket, count(*) AS n FROM op, top WHERE duration_ms > 0 AND floor(duration_ms / (top / 30)) < 30 GROUP BY 1""",
    "series_summary": f"""WITH {OPS}
SELECT (SELECT round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000), 9) FROM ev) AS events_per_s, round(avg(duration_ms), 6) AS avg_ms,
  round(quantile_disc(duration_ms, 0.95), 6) AS p95_ms FROM op WHERE duration_ms > 0""",
    "perf_compare": f"""WITH {OPS}, a AS ({_SIDE.format(f"start_ms < {SPLIT_MS}")}), b AS ({_SIDE.format(f"start_ms >= {SPLIT_MS} AND channel <> 'app:view'")}),
j AS (SELECT coalesce(a.channel, b.channel) AS channel, a.total AS total_a, a.error AS error_a, a.avg_ms AS avg_ms_a, a.p95_ms AS p95_ms_a,
  b.total AS total_b, b.error AS error_b, b.avg_ms AS avg_ms_b, b.p95_ms AS p95_ms_b FROM a FULL JOIN b ON a.channel = b.channel)
SELECT channel, coalesce(total_a, 0) AS total_a, coalesce(error_a, 0) AS error_a, coalesce(avg_ms_a, 0) AS avg_ms_a, coalesce(p95_ms_a, 0) AS p95_ms_a,
  coalesce(total_b, 0) AS total_b, coalesce(error_b, 0) AS error_b, coalesce(avg_ms_b, 0) AS avg_ms_b, coalesce(p95_ms_b, 0) AS p95_ms_b,
  {_CHANGE.format("avg_ms")} AS avg_change, {_CHANGE.format("p95_ms")} AS p95_change FROM j""",
    "validator_issues": f"WITH {_ODD} SELECT channel, severity, category, n FROM issue",
    "validator_channels": f"""WITH {_ODD}, s AS (SELECT channel, sum(n) FILTER (WHERE severity = 'error') AS e, sum(n) FILTER (WHERE severity = 'warning') AS w,
  sum(n) FILTER (WHERE severity = 'info') AS i FROM issue GROUP BY channel), c AS (SELECT channel, count(*) AS n_events FROM odd GROUP BY channel)
SELECT coalesce(s.channel, c.channel) AS channel, coalesce(n_events, 0) AS n_events, coalesce(e, 0)::BIGINT AS n_error, coalesce(w, 0)::BIGINT AS n_warning,
  coalesce(i, 0)::BIGINT AS n_info, coalesce(e, 0) = 0 AS valid FROM c FULL JOIN s ON s.channel = c.channel""",
    "bottlenecks": f"""WITH {OPS}, cut AS (SELECT quantile_disc(duration_ms, 0.95) AS cut FROM op)
SELECT op_key, channel, round(duration_ms, 3) AS duration_ms FROM op, cut WHERE duration_ms >= cut AND duration_ms > 0""",
    "n_plus_one": f"WITH {_CALLS} SELECT parent_id, channel, queries FROM n1 WHERE queries >= 15",
    "gate": f"""WITH {_CALLS}, r AS (
  SELECT 'p99-latency' AS rule, coalesce(quantile_disc(duration_ms, 0.99), 0) AS actual, 500.0::DOUBLE AS threshold FROM op WHERE duration_ms > 0
  UNION ALL SELECT 'n1-sql', count(*)::DOUBLE, 0.0 FROM n1 WHERE queries >= 30
  UNION ALL SELECT 'event-loop-delay', quantile_disc(duration_ms, 0.99), 20.0 FROM ev WHERE channel = 'app:view' AND duration_ms > 0)
SELECT rule, CASE WHEN actual IS NULL THEN 'skipped' WHEN actual <= threshold THEN 'pass' ELSE 'fail' END AS status, round(coalesce(actual, 0), 6) AS actual, threshold FROM r""",
}
