"""Queries over causal graphs. Operations last `value` minutes here, so that they overlap within a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, core, gate
from .bridge import OPS, SESSION, raw, sessions, trace_events

MINUTE = 60000.0


def events(spark, d):
    """Start and end records; short operations name the event before in their session as parent, the longest
    a missing one; every second without a start names it in its end record; others name what triggered them."""
    rows = sessions(spark, d)
    before = F.col("previous").cast("string")
    parent = F.when(F.col("value") > 480, F.when(F.col("event_id") % 2 == 0, before)).when(F.col("value") < 100, before).when(F.col("value") > 470, F.concat(F.lit("lost-"), "event_id"))
    rows = rows.withColumn("parent", parent)
    start = F.when(F.col("value") <= 480, F.struct((F.col("event_id") * 2).alias("seq"), F.lit("start").alias("type"), F.col("ts_ms").alias("ts")))
    end = F.when(F.col("value") >= 10, F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.when(F.col("event_type") == "error", "error").otherwise("end").alias("type"), (F.col("ts_ms") + F.col("value") * MINUTE).alias("ts")))
    rows = rows.withColumn("r", F.explode(F.array_compact(F.array(start, end))))
    start = F.col("r.type") == "start"
    pairs = F.array(
        F.when(F.col("parent").isNotNull() & start, F.concat(F.lit('"parentOperationId":"'), "parent", F.lit('"'))), F.when(F.col("parent").isNotNull() & ~start, F.concat(F.lit('"parent_span_id":"'), "parent", F.lit('"'))),
        F.concat(F.lit('"asyncId":"a-'), "event_id", F.lit('"')), F.when(F.col("event_id") % 7 == 3, F.concat(F.lit('"trigger_async_id":"a-'), "previous", F.lit('"'))),
    )
    context = F.concat(F.lit("{"), F.array_join(F.array_compact(pairs), ","), F.lit("}"))
    return rows.select("r.seq", F.concat(F.lit("app:"), "event_type").alias("channel"), F.col("r.type").alias("event_type"), F.col("r.ts").alias("ts_ms"), F.col("event_id").cast("string").alias("operation_id"), context.alias("context_json"), "user_id")


NODE = SESSION + f""",
node AS (
  SELECT event_id::VARCHAR AS id, 'app:' || event_type AS channel, CASE WHEN value <= 480 THEN ts_ms ELSE ts_ms + value * {MINUTE} END AS start_ms,
    CASE WHEN value >= 10 THEN ts_ms + value * {MINUTE} END AS end_ms,
    CASE WHEN value < 10 THEN 'incomplete' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    value > 480 AS unpaired, CASE WHEN value <= 480 THEN event_id * 2 ELSE event_id * 2 + 1 END AS seq, user_id,
    CASE WHEN value > 480 THEN (CASE WHEN event_id % 2 = 0 THEN previous::VARCHAR END) WHEN value < 100 THEN previous::VARCHAR WHEN value > 470 THEN 'lost-' || event_id END AS declared,
    CASE WHEN event_id % 7 = 3 THEN previous::VARCHAR END AS trigger_id
  FROM ses
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, seq) AS rn, coalesce(end_ms, 'infinity'::DOUBLE) AS until FROM node),
around AS (
  SELECT c.id, arg_max(p.id, p.rn) AS parent_id FROM ranked c JOIN ranked p ON p.user_id = c.user_id AND p.rn < c.rn AND p.until >= c.until GROUP BY c.id
),
edge AS (
  SELECT CASE WHEN k.id IS NOT NULL THEN n.declared WHEN n.declared IS NOT NULL THEN 'virtual:' || n.declared WHEN t.id IS NOT NULL THEN t.id WHEN a.parent_id IS NOT NULL THEN a.parent_id
      WHEN n.unpaired THEN 'virtual:orphan:' || n.id END AS parent_id, n.id AS child_id,
    CASE WHEN k.id IS NOT NULL THEN 'explicit-parent' WHEN n.declared IS NOT NULL THEN 'gap-healed' WHEN t.id IS NOT NULL THEN 'async-context' WHEN a.parent_id IS NOT NULL THEN 'containment' ELSE 'gap-healed' END AS kind,
    CASE WHEN k.id IS NOT NULL OR (n.declared IS NULL AND t.id IS NOT NULL) THEN 'high' WHEN n.declared IS NULL AND a.parent_id IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
  FROM node n LEFT JOIN node k ON k.id = n.declared LEFT JOIN node t ON t.id = n.trigger_id AND NOT t.unpaired LEFT JOIN around a ON a.id = n.id
  WHERE k.id IS NOT NULL OR n.declared IS NOT NULL OR t.id IS NOT NULL OR a.parent_id IS NOT NULL OR n.unpaired
)"""
FOREST = "WITH RECURSIVE " + NODE + """,
graph AS (
  SELECT n.id, e.parent_id, false AS virtual, n.start_ms FROM node n LEFT JOIN edge e ON e.child_id = n.id
  UNION ALL SELECT parent_id, NULL, true, min(n.start_ms) FROM edge e JOIN node n ON n.id = e.child_id WHERE parent_id LIKE 'virtual:%' GROUP BY 1
),
walk AS (
  SELECT id, id AS root, 0 AS depth, CASE WHEN virtual THEN -1 ELSE 0 END AS shown FROM graph WHERE parent_id IS NULL
  UNION ALL SELECT g.id, w.root, w.depth + 1, w.shown + 1 FROM graph g JOIN walk w ON g.parent_id = w.id
)"""


def _nodes(spark, d):
    return causal.causal_nodes(events(spark, d), "user_id")


def _graph(spark, d):
    nodes = _nodes(spark, d)
    return causal.with_virtual(nodes, causal.causal_edges(nodes, "user_id"), "user_id")


def causal_nodes(spark, d):
    return _nodes(spark, d).select("id", "channel", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "status", "unpaired", "declared")


def causal_edges(spark, d):
    return causal.causal_edges(_nodes(spark, d), "user_id")


def causal_counters(spark, d):
    nodes = _nodes(spark, d)
    return causal.graph_counters(nodes, causal.causal_edges(nodes, "user_id"))


def causal_forest(spark, d):
    return causal.forest(_graph(spark, d)).select("id", "root", "depth", "cyclic")


def waterfall(spark, d):
    return causal.waterfall(_graph(spark, d), "user_id")


def overlap_parents(spark, d):
    return causal.overlap_parents(core.pair_operations(events(spark, d)), "user_id")


def sequential_links(spark, d):
    return causal.sequential_links(core.pair_operations(trace_events(spark, d)), "user_id", most_ms=MINUTE * 30)


def dependencies(spark, d):
    nodes = _nodes(spark, d)
    links = causal.sequential_links(core.pair_operations(trace_events(spark, d)), "user_id", most_ms=MINUTE * 30)
    return causal.dependencies(causal.causal_edges(nodes, "user_id"), links)


def causal_summary(spark, d):
    return causal.graph_summary(causal.causal_edges(_nodes(spark, d), "user_id"))


def _rings(spark, d):
    """Tens of events: the first and the sixth name each other, the others the one before."""
    rows = raw(spark, d)
    e = F.col("event_id")
    parent = F.when(e % 10 == 0, e + 5).when(e % 10 == 5, e - 5).otherwise(e - 1)
    return rows.select(F.format_string("%09d", e).alias("id"), F.format_string("%09d", parent).alias("parent_id"), F.lit(False).alias("virtual"), F.col("ts_ms").alias("start_ms"), "user_id")


def causal_cycles(spark, d):
    return causal.forest(_rings(spark, d)).select("id", "parent_id", "root", "depth", "cyclic")


def cycle_paths(spark, d):
    return causal.cycle_paths(_rings(spark, d)).select("cycle", F.array_join("path", ">").alias("path"))


def cyclic_waterfall(spark, d):
    return causal.waterfall(_rings(spark, d)).filter("parent_id IS NOT NULL")


def span_errors(spark, d):
    ops = core.pair_operations(trace_events(spark, d))
    errors = trace_events(spark, d).filter("event_type = 'error'").select(F.col("operation_id").alias("op_key"), "error_message")
    spans = causal.waterfall(_graph(spark, d), "user_id")
    return causal.attach_errors(spans, ops.drop("error_message").join(errors, "op_key")).filter("error_message IS NOT NULL").select("id", "depth", "error_message")


def gate_of_events(spark, d):
    rows = events(spark, d).withColumn("channel", F.when(F.col("channel") == "app:click", "mysql2:query").otherwise(F.col("channel")))
    rows = rows.withColumn("error_message", F.lit(None).cast("string")).withColumn("duration_ms", F.lit(None).cast("double"))
    return gate.evaluate(rows, {"p99MaxMs": 25_000_000.0}, "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        causal_nodes, causal_edges, causal_counters, causal_forest, waterfall, overlap_parents, sequential_links, dependencies,
        causal_summary, causal_cycles, cycle_paths, cyclic_waterfall, span_errors, gate_of_events,
    )
}

_OVERLAP = NODE + f""",
bop AS (
  SELECT id, user_id, CASE WHEN status = 'incomplete' OR unpaired OR status = 'success' OR status = 'error' THEN start_ms END AS start_ms,
    CASE WHEN status = 'success' THEN end_ms END AS end_ms, CASE WHEN end_ms IS NULL THEN seq ELSE (id::BIGINT) * 2 + 1 END AS seq FROM node
),
bo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, seq) AS rn, coalesce(end_ms, 'infinity'::DOUBLE) AS until FROM bop)"""
_SEQ = """,
ordered AS (SELECT *, lag(op_key) OVER w AS k, lag(coalesce(end_ms, start_ms)) OVER w AS e FROM op WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, seq)),
link AS (SELECT k AS source, op_key AS target FROM ordered WHERE start_ms - e BETWEEN 0 AND """ + str(MINUTE * 30) + ")"

_RINGS = """WITH e AS (SELECT event_id, epoch_us(ts)::DOUBLE / 1000.0::DOUBLE AS ts_ms, CASE event_id % 10 WHEN 0 THEN event_id + 5 WHEN 5 THEN event_id - 5 ELSE event_id - 1 END AS up FROM events),
k AS (SELECT e.*, p.event_id IS NOT NULL AS there, p.event_id IS NOT NULL AND e.event_id % 5 = 0 AS cyclic FROM e LEFT JOIN events p ON p.event_id = e.up),
-- every run of five hangs off its first event, which is on a ring or has no parent
r AS (SELECT *, format('{:09d}', event_id) AS id, CASE WHEN NOT cyclic THEN format('{:09d}', up) END AS parent_id,
  (event_id - (SELECT max(f.event_id) FROM k f WHERE f.event_id <= k.event_id AND (f.cyclic OR NOT f.there)))::BIGINT AS depth,
  format('{:09d}', (SELECT max(f.event_id) FROM k f WHERE f.event_id <= k.event_id AND (f.cyclic OR NOT f.there))) AS root FROM k)"""

ORACLE_SQL = {
    "causal_nodes": f"WITH {NODE} SELECT id, channel, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, status, unpaired, declared FROM node",
    "causal_edges": f"WITH {NODE} SELECT parent_id, child_id, kind, confidence FROM edge",
    "causal_counters": f"WITH {NODE} SELECT kind, confidence, count(*) AS n FROM edge GROUP BY 1, 2",
    "causal_forest": f"{FOREST} SELECT id, root, depth::BIGINT AS depth, false AS cyclic FROM walk",
    "waterfall": f"""{FOREST}, shown AS (SELECT g.id, CASE WHEN g.parent_id LIKE 'virtual:%' THEN NULL ELSE g.parent_id END AS parent_id, w.shown::INT AS depth, n.user_id, n.start_ms
FROM graph g JOIN walk w USING (id) JOIN node n USING (id) WHERE NOT virtual)
SELECT id, parent_id, depth, row_number() OVER (PARTITION BY parent_id, user_id ORDER BY start_ms, id) AS place FROM shown""",
    "causal_summary": f"""WITH {NODE} SELECT count(*) AS edges, count(*) FILTER (WHERE kind = 'gap-healed') AS gap_heals, count(*) FILTER (WHERE parent_id LIKE 'virtual:%') AS orphans,
count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low FROM edge""",
    "causal_cycles": f"{_RINGS} SELECT id, parent_id, root, depth, cyclic FROM r",
    "cycle_paths": f"{_RINGS} SELECT id AS cycle, id || '>' || format('{{:09d}}', event_id + 5) || '>' || id AS path FROM r WHERE cyclic AND event_id % 10 = 0",
    "cyclic_waterfall": f"{_RINGS} SELECT id, parent_id, depth::INT AS depth, row_number() OVER (PARTITION BY parent_id ORDER BY ts_ms, id) AS place FROM r WHERE parent_id IS NOT NULL AND there",
    "span_errors": f"{FOREST} SELECT id, w.shown::INT AS depth, 'failed ' || e.props AS error_message FROM node n JOIN walk w USING (id) JOIN events e ON e.event_id::VARCHAR = n.id WHERE e.event_type = 'error' AND e.value >= 10",
    "overlap_parents": f"WITH {_OVERLAP} SELECT c.id, arg_max(p.id, p.rn) AS parent_id FROM bo c JOIN bo p ON p.user_id = c.user_id AND p.rn < c.rn AND p.until >= c.start_ms GROUP BY c.id",
    "sequential_links": f"WITH {OPS}{_SEQ} SELECT source, target FROM link",
    "dependencies": f"WITH {NODE}, {OPS}{_SEQ} SELECT parent_id AS source, child_id AS target, 'parent-child' AS type FROM edge WHERE parent_id NOT LIKE 'virtual:%' UNION ALL SELECT source, target, 'sequential' FROM link",
    "gate_of_events": f"""WITH {NODE}, p AS (SELECT quantile_disc(value * {MINUTE}, 0.99) AS a FROM events WHERE value BETWEEN 10 AND 480),
n AS (SELECT count(*)::DOUBLE AS a FROM (SELECT parent_id FROM edge JOIN node ON id = child_id WHERE channel = 'app:click' AND parent_id NOT LIKE 'virtual:%' GROUP BY 1 HAVING count(*) >= 3))
SELECT 'p99-latency' AS rule, CASE WHEN a <= 25000000 THEN 'pass' ELSE 'fail' END AS status, round(a, 6) AS actual, 25000000.0::DOUBLE AS threshold FROM p
UNION ALL SELECT 'n1-sql', CASE WHEN a <= 0 THEN 'pass' ELSE 'fail' END, a, 0 FROM n UNION ALL SELECT 'event-loop-delay', 'skipped', 0, 20""",
}
