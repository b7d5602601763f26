"""Queries over memory series, collector logs, alerts, heaps and CPU profiles made of the driver's tables.

A memory series per order status: a sample per day, a second apart, sized by that day's orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heap, memory
from ..operators.trees import preorder
from .bridge import SPAN, raw, spans, table

_DAY = "datediff(o_orderdate, DATE'1995-01-01') * 1000D"


def samples(spark, d):
    o = table(spark, d, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    s = o.groupBy(F.col("o_orderstatus").alias("series"), F.expr(_DAY).alias("ts_ms")).agg(F.floor(total * 40).cast("double").alias("heap_used"), (F.count("*") * 1500000).cast("double").alias("external"))
    return s.withColumn("heap_total", F.col("heap_used") * 1.25).withColumn("rss", F.col("heap_used") + F.col("external"))


SAMPLE = """sample AS (
  SELECT o_orderstatus AS series, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 1000.0::DOUBLE AS ts_ms,
    floor(sum(o_totalprice::DECIMAL(18, 2)) * 40)::DOUBLE AS heap_used, (count(*) * 1500000)::DOUBLE AS external
  FROM orders GROUP BY 1, 2
),
mem AS (SELECT *, heap_used * 1.25::DOUBLE AS heap_total, heap_used + external AS rss FROM sample)"""


def memory_growth(spark, d):
    return memory.growth(samples(spark, d))


def gc_log(spark, d):
    """Collector lines written from events, and read again."""
    e = raw(spark, d)
    kind = F.when(F.col("event_type") == "error", "Mark-sweep").when(F.col("event_type") == "view", "Mark-sweep (reduce)").otherwise("Scavenge")
    line = F.concat(F.lit("[1:0x1] "), F.col("event_id").cast("string"), F.lit(" ms: "), kind, F.lit(" "), F.format_string("%.1f (600.0) -> %.1f (600.0) MB, %.1f / 0.0 ms  (average mu = 0.99)", F.round("value", 1), F.round(F.col("value") / 2, 1), F.round(F.col("value") / 100, 1)))
    return memory.gc_entries(e.select(F.col("event_id").alias("seq"), line.alias("line")))


def gc_entries(spark, d):
    return gc_log(spark, d).withColumn("pause_ms", F.round("pause_ms", 6))


def gc_summary(spark, d):
    return memory.gc_summary(gc_log(spark, d))


def _rules(spark):
    rows = [("r1", "heapUsedPercent", "greaterThan", 79.0, "critical", True), ("r2", "externalMemory", "greaterThanOrEqual", 1.0, "warning", True), ("r3", "heapGrowthRate", "lessThan", 0.0, "info", True),
            ("r4", "errorRate", "greaterThan", 5.0, "warning", True), ("r5", "eventRate", "lessThanOrEqual", 1e9, "info", True), ("r6", "rssGrowthRate", "greaterThan", -1e9, "info", False)]
    return spark.createDataFrame(rows, "id string, metric string, operator string, threshold double, level string, enabled boolean")


def _metrics(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"))
    rates = o.agg((F.count_if(F.col("o_orderpriority").startswith("1")) / F.count("*") * 100).alias("error_rate"), F.count("*").alias("event_rate"))
    return memory.metrics(samples(spark, d), rates)


def alert_metrics(spark, d):
    return _metrics(spark, d)


def alerts_fired(spark, d):
    return memory.fired(_rules(spark), _metrics(spark, d))


def gc_inferred(spark, d):
    return memory.inferred_runs(samples(spark, d)).withColumn("reclaimed_mb", F.round("reclaimed_mb", 6))


def gc_pressure(spark, d):
    return memory.gc_pressure(memory.inferred_runs(samples(spark, d)), most_mb=16.0)


def leak_samples(spark, d):
    busy = F.when(F.pmod(F.floor(F.col("ts_ms") / 1000), F.lit(40)) < 12, F.col("heap_used") * 1.01).otherwise(F.col("heap_total"))
    return samples(spark, d).withColumn("heap_total", busy)


def leak_trend(spark, d):
    return memory.leak_trend(leak_samples(spark, d), rate_bps=memory.MIB / 4)


def _history(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("ts_ms")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = F.lag("n").over(Window.partitionBy("series").orderBy("ts_ms"))
    rows = o.withColumn("delta", F.coalesce(F.col("n") - before, F.lit(0))).withColumn("growth_rate", (F.col("n") - before) / before)
    return rows.withColumn("flagged", F.coalesce(F.col("growth_rate") > 0.05, F.lit(False)))


def snapshot_pattern(spark, d):
    return memory.leak_pattern(_history(spark, d))


def snapshot_history(spark, d):
    return memory.history_summary(_history(spark, d))


def _heap(spark, d, late=None):
    """Parts' line items as heap nodes: name the part's brand, type by return flag, sizes by price."""
    line = table(spark, d, "lineitem")
    if late is not None:
        line = line.filter((F.year("l_shipdate") >= 1998) == late)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    size = F.floor(F.col("l_extendedprice") * 20).cast("long")
    kind = F.when(F.col("l_returnflag") == "R", "closure").when(F.col("l_returnflag") == "A", "string").otherwise("object")
    name = F.when(F.col("p_type") == "ECONOMY", F.concat("p_brand", F.lit(" Listener"))).otherwise(F.col("p_brand"))
    return line.join(part, "l_partkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name.alias("name"), kind.alias("type"), size.alias("self_size"), size.alias("retained_size"))


HEAP = """heap AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN p_type = 'ECONOMY' THEN p_brand || ' Listener' ELSE p_brand END AS name,
    CASE WHEN l_returnflag = 'R' THEN 'closure' WHEN l_returnflag = 'A' THEN 'string' ELSE 'object' END AS type,
    floor(l_extendedprice * 20)::BIGINT AS self_size, floor(l_extendedprice * 20)::BIGINT AS retained_size, year(l_shipdate) >= 1998 AS late
  FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def heap_diff(spark, d):
    return heap.diff(_heap(spark, d, False), _heap(spark, d, True))


def heap_hot_objects(spark, d):
    return heap.hot_objects(_heap(spark, d)).select("id", "retained_size")


def heap_top_names(spark, d):
    return heap.top_names(_heap(spark, d))


def heap_leaks(spark, d):
    return heap.leak_suspects(_heap(spark, d))


def heap_strings(spark, d):
    return heap.string_stats(_heap(spark, d))


def _graph(spark, d):
    s = spans(spark, d)
    nodes = s.select(F.col("span_id").alias("id"), F.col("service").alias("name"), F.col("name").alias("type"), F.floor(F.col("end_ms") - F.col("start_ms")).cast("long").alias("self_size"))
    edges = s.filter("parent_span_id IS NOT NULL").select(F.col("parent_span_id").alias("from_id"), F.col("span_id").alias("to_id"), F.col("span_id").alias("name"), F.col("start_ms").alias("seq"))
    return nodes, edges


def heap_retained(spark, d):
    return heap.retained_sizes(*_graph(spark, d)).select("id", "self_size", "retained_size")


def heap_shared(spark, d):
    """A third of a trace's spans refer to its last one too, and every other last one to the first: shared nodes and cycles."""
    nodes, edges = _graph(spark, d)
    s = spans(spark, d).withColumn("i", F.col("span_id").cast("long"))
    ends = s.groupBy("trace_id").agg(F.min("i").alias("low"), F.max("i").alias("high")).filter("low < high")
    more = s.filter("i % 3 = 0").join(ends, "trace_id").select(F.col("i").alias("a"), F.col("high").alias("b")).unionByName(ends.filter("high % 2 = 0").select(F.col("high").alias("a"), F.col("low").alias("b")))
    more = more.select(F.col("a").cast("string").alias("from_id"), F.col("b").cast("string").alias("to_id"), F.lit("more").alias("name"), F.lit(0.0).alias("seq"))
    return heap.retained_sizes(nodes, edges.unionByName(more)).select("id", "retained_size")


def flattened_page(spark, d):
    """A page of the flattened forest of all spans: places 100 to 399."""
    flat = preorder(spans(spark, d), ["span_id"], "parent_span_id", ["start_ms"])
    return flat.filter("place BETWEEN 100 AND 399").select("span_id", "place", "depth", "size")


def heap_root_path(spark, d):
    return heap.root_path(_graph(spark, d)[1])


def cpu_functions(spark, d):
    s = spans(spark, d)
    nodes = s.select(F.col("span_id").alias("id"), F.col("parent_span_id").alias("parent_id"), F.col("service").alias("function"))
    return heap.cpu_functions(nodes, s.select(F.col("span_id").alias("node_id"), F.round((F.col("end_ms") - F.col("start_ms")) * 1000).cast("long").alias("delta_us")))


QUERIES = {
    f.__name__: f
    for f in (memory_growth, gc_entries, gc_summary, alert_metrics, alerts_fired, gc_inferred, gc_pressure, leak_trend, snapshot_pattern, snapshot_history,
              heap_diff, heap_hot_objects, heap_top_names, heap_leaks, heap_strings, heap_retained, heap_shared, heap_root_path, cpu_functions, flattened_page)
}

_METRIC = SAMPLE + """,
last AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ms DESC) AS r FROM mem QUALIFY r <= 20),
m AS (
  SELECT series, max(CASE WHEN r = 1 THEN heap_used / heap_total * 100 END) AS a, max(CASE WHEN r = 1 THEN external / 1048576 END) AS b,
    coalesce(regr_slope(heap_used, ts_ms), 0) * 1000 / 1048576 AS c, coalesce(regr_slope(rss, ts_ms), 0) * 1000 / 1048576 AS d FROM last GROUP BY series
),
rate AS (SELECT o_orderstatus AS series, count(*) FILTER (WHERE o_orderpriority LIKE '1%')::DOUBLE / count(*) * 100 AS e, count(*)::DOUBLE AS f FROM orders GROUP BY 1),
metric AS (
  SELECT series, 'heapUsedPercent' AS metric, round(a, 6) AS value FROM m UNION ALL SELECT series, 'externalMemory', round(b, 6) FROM m
  UNION ALL SELECT series, 'heapGrowthRate', round(c, 6) FROM m UNION ALL SELECT series, 'rssGrowthRate', round(d, 6) FROM m
  UNION ALL SELECT series, 'errorRate', round(e, 6) FROM rate UNION ALL SELECT series, 'eventRate', f FROM rate
)"""
_RUNS = SAMPLE + """,
run AS (SELECT series, ts_ms, (lag(heap_used) OVER w - heap_used) / 1048576 AS reclaimed_mb FROM mem WINDOW w AS (PARTITION BY series ORDER BY ts_ms) QUALIFY reclaimed_mb > 1)"""
_STREAK = """island AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts_ms) AS i FROM breach),
streak AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY series, i ORDER BY ts_ms)::BIGINT AS streak FROM island)"""
_HISTORY = """month AS (SELECT o_orderstatus AS series, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS ts_ms, count(*) AS n FROM orders GROUP BY 1, 2),
hist AS (SELECT *, n - lag(n) OVER w AS d, (n - lag(n) OVER w)::DOUBLE / lag(n) OVER w AS g FROM month WINDOW w AS (PARTITION BY series ORDER BY ts_ms))"""
_TREE = "WITH RECURSIVE " + SPAN + """,
walk AS (SELECT span_id AS id, span_id AS to_id FROM span UNION SELECT w.id, s.span_id FROM walk w JOIN span s ON s.parent_span_id = w.to_id)"""

ORACLE_SQL = {
    "memory_growth": f"""WITH {SAMPLE}, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM mem),
g AS (SELECT series, round(coalesce(regr_slope(external, ts_ms), 0) * 1000 / 1048576, 6) AS external_mb_s, round(coalesce(regr_slope(heap_used, ts_ms), 0) * 1000 / 1048576, 6) AS heap_mb_s,
  round(coalesce(regr_slope(rss, ts_ms), 0) * 1000 / 1048576, 6) AS rss_mb_s FROM i WHERE i >= n // 2 GROUP BY series)
SELECT *, external_mb_s > 1 OR rss_mb_s > 2 AS flagged FROM g""",
    "gc_entries": """SELECT event_id AS seq, event_id AS ts_ms, CASE WHEN event_type = 'error' THEN 'Mark-sweep' ELSE 'Scavenge' END AS type, floor(round(value, 1) * 1048576)::BIGINT AS heap_before, floor(round(value / 2, 1) * 1048576)::BIGINT AS heap_after,
round(round(value / 100, 1), 6) AS pause_ms, CASE WHEN event_type = 'error' THEN 'major' ELSE 'minor' END AS pause_type FROM events WHERE event_type <> 'view'""",
    "gc_summary": """WITH g AS (SELECT *, event_type = 'error' AS major, floor(round(value, 1) * 1048576) AS b, floor(round(value / 2, 1) * 1048576) AS a, round(value / 100, 1) AS p FROM events WHERE event_type <> 'view'),
s AS (SELECT count(*) AS runs, count(*) FILTER (WHERE major) AS major, count(*) FILTER (WHERE NOT major) AS minor, round(sum(p), 6) AS pause_ms, round(coalesce(avg(p) FILTER (WHERE major), 0), 6) AS avg_major_ms, round(coalesce(avg(p) FILTER (WHERE NOT major), 0), 6) AS avg_minor_ms,
  round((arg_max(a, event_id) - arg_min(b, event_id)) / 1048576, 6) AS growth_mb FROM g)
SELECT *, growth_mb > 50 AS unmanaged FROM s""",
    "alert_metrics": f"WITH {_METRIC} SELECT series, metric, value FROM metric",
    "alerts_fired": f"""WITH {_METRIC}, r AS (SELECT * FROM (VALUES ('r1', 'heapUsedPercent', 79.0::DOUBLE, 'critical', 'Heap Used % > 79.0%. Current: '), ('r2', 'externalMemory', 1.0, 'warning', 'External Memory >= 1.0 MB. Current: '),
  ('r3', 'heapGrowthRate', 0.0, 'info', 'Heap Growth Rate < 0.00 MB/s. Current: '), ('r4', 'errorRate', 5.0, 'warning', 'Error Rate > 5.0%. Current: '), ('r5', 'eventRate', 1e9, 'info', 'Event Rate <= 1000000000 evt/s. Current: ')) AS t(id, metric, threshold, level, said))
SELECT series, id, metric, value, threshold, level, said || CASE metric WHEN 'heapUsedPercent' THEN printf('%.1f%%', round(value, 1)) WHEN 'errorRate' THEN printf('%.1f%%', round(value, 1)) WHEN 'externalMemory' THEN printf('%.1f MB', round(value, 1))
  WHEN 'eventRate' THEN printf('%.0f evt/s', value) ELSE printf('%.2f MB/s', round(value, 2)) END AS message FROM metric JOIN r USING (metric)
WHERE (metric = 'heapUsedPercent' AND value > 79) OR (metric = 'externalMemory' AND value >= 1) OR (metric = 'heapGrowthRate' AND value < 0) OR (metric = 'errorRate' AND value > 5) OR (metric = 'eventRate' AND value <= 1e9)""",
    "gc_inferred": f"WITH {_RUNS} SELECT series, ts_ms, round(reclaimed_mb, 6) AS reclaimed_mb FROM run",
    "gc_pressure": f"""WITH {_RUNS}, churn AS (SELECT series, ts_ms, round(sum(reclaimed_mb) OVER (PARTITION BY series ORDER BY ts_ms::BIGINT RANGE BETWEEN 9999 PRECEDING AND CURRENT ROW), 6) AS churn_mb FROM run),
breach AS (SELECT *, churn_mb > 16 AS b FROM churn), {_STREAK} SELECT series, ts_ms, churn_mb, streak FROM streak WHERE streak > 0 AND streak % 5 = 0""",
    "leak_trend": f"""WITH {SAMPLE}, r AS (SELECT series, ts_ms, greatest(coalesce(regr_slope(heap_used, ts_ms / 1000) OVER (PARTITION BY series ORDER BY ts_ms ROWS 19 PRECEDING), 0), 0) AS rate,
  heap_used / CASE WHEN ((floor(ts_ms / 1000)::BIGINT % 40) + 40) % 40 < 12 THEN heap_used * 1.01::DOUBLE ELSE heap_total END * 100 AS used FROM mem),
breach AS (SELECT *, rate > 262144 OR used > 90 AS b FROM r), {_STREAK} SELECT series, ts_ms, CASE WHEN rate > 262144 THEN 'critical' ELSE 'warning' END AS level, CASE WHEN rate > 262144 THEN 'heapGrowthRate' ELSE 'heapUsedPercent' END AS metric, round(CASE WHEN rate > 262144 THEN rate / 1048576 ELSE used END, 6) AS value, streak FROM streak WHERE streak >= 3 AND streak % 3 = 0""",
    "snapshot_pattern": f"""WITH {_HISTORY}, l AS (SELECT *, coalesce(d, 0) AS delta, row_number() OVER (PARTITION BY series ORDER BY ts_ms DESC) AS r FROM hist QUALIFY r <= 3)
SELECT series, CASE WHEN count(*) >= 3 AND bool_and(delta > 0) THEN 'growing' WHEN max(CASE WHEN r = 1 THEN delta END) < 0 THEN 'shrinking' ELSE 'stable' END AS pattern, count(*) >= 3 AND bool_and(delta > 0) AS flagged FROM l GROUP BY series""",
    "snapshot_history": f"WITH {_HISTORY} SELECT count(*) AS records, round(avg(coalesce(g, 0)), 6) AS avg_growth, count(*) FILTER (WHERE g > 0.05) AS flagged FROM hist",
    "heap_diff": f"""WITH {HEAP}, a AS (SELECT name, type, count(*) AS c, sum(retained_size)::BIGINT AS s FROM heap WHERE NOT late GROUP BY 1, 2), b AS (SELECT name, type, count(*) AS c, sum(retained_size)::BIGINT AS s FROM heap WHERE late GROUP BY 1, 2),
j AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.type, b.type) AS type, coalesce(a.c, 0) AS before_count, coalesce(a.s, 0) AS before_size, coalesce(b.c, 0) AS after_count, coalesce(b.s, 0) AS after_size FROM a FULL JOIN b ON a.name = b.name AND a.type = b.type)
SELECT *, after_count - before_count AS count_delta, after_size - before_size AS size_delta,
  CASE WHEN before_count = 0 THEN 'new' WHEN after_count = 0 THEN 'removed' WHEN after_count > before_count THEN 'growing' ELSE 'other' END AS change FROM j""",
    "heap_hot_objects": f"WITH {HEAP} SELECT id, retained_size FROM heap WHERE retained_size > 0 AND type NOT IN ('string', 'number') ORDER BY retained_size DESC, id LIMIT 100",
    "heap_top_names": f"WITH {HEAP} SELECT name, sum(retained_size)::BIGINT AS size, count(*) AS count FROM heap WHERE retained_size > 1024 GROUP BY name ORDER BY size DESC, name LIMIT 20",
    "heap_leaks": f"""WITH {HEAP} SELECT 'unbounded-cache' AS category, 'high' AS severity, name, count(*) AS n, sum(retained_size)::BIGINT AS retained FROM heap WHERE type IN ('object', 'closure') GROUP BY name HAVING count(*) > 100 AND sum(retained_size) > 10485760
UNION ALL SELECT 'closure-capture', 'medium', name, 1, retained_size FROM heap WHERE type = 'closure' AND retained_size > 1048576
UNION ALL SELECT 'listener-accumulation', 'medium', name, 1, retained_size FROM heap WHERE (contains(lower(name), 'listener') OR contains(lower(name), 'eventemitter')) AND retained_size > 5242880""",
    "heap_strings": f"WITH {HEAP} SELECT type, count(*) AS n, sum(self_size)::BIGINT AS bytes FROM heap WHERE type = 'string' GROUP BY type",
    "heap_retained": f"""{_TREE} SELECT w.id, any_value(o.sz)::BIGINT AS self_size, sum(t.sz)::BIGINT AS retained_size FROM walk w JOIN (SELECT span_id, floor(end_ms - start_ms)::BIGINT AS sz FROM span) t ON t.span_id = w.to_id
JOIN (SELECT span_id, floor(end_ms - start_ms)::BIGINT AS sz FROM span) o ON o.span_id = w.id GROUP BY w.id""",
    "heap_shared": "WITH RECURSIVE " + SPAN + """, tip AS (SELECT trace_id, min(span_id::BIGINT) AS low, max(span_id::BIGINT) AS high FROM span GROUP BY 1 HAVING low < high),
edge AS (SELECT parent_span_id AS a, span_id AS b FROM span WHERE parent_span_id IS NOT NULL UNION SELECT span_id, high::VARCHAR FROM span JOIN tip USING (trace_id) WHERE span_id::BIGINT % 3 = 0 UNION SELECT high::VARCHAR, low::VARCHAR FROM tip WHERE high % 2 = 0),
walk AS (SELECT span_id AS id, span_id AS to_id FROM span UNION SELECT w.id, e.b FROM walk w JOIN edge e ON e.a = w.to_id)
SELECT w.id, sum(floor(end_ms - start_ms))::BIGINT AS retained_size FROM walk w JOIN span s ON s.span_id = w.to_id GROUP BY 1""",
    "flattened_page": "WITH RECURSIVE " + SPAN + """, walk AS (SELECT span_id, [format('{:020.3f} ', start_ms) || span_id] AS path FROM span WHERE parent_span_id IS NULL
  UNION ALL SELECT s.span_id, list_append(w.path, format('{:020.3f} ', s.start_ms) || s.span_id) FROM walk w JOIN span s ON s.parent_span_id = w.span_id),
flat AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS place, len(path) - 1 AS depth FROM walk),
below AS (SELECT f.span_id, count(*) AS size FROM flat f JOIN walk w ON w.path[len(f.path)] = f.path[len(f.path)] AND w.path[1:len(f.path)] = f.path WHERE place BETWEEN 100 AND 399 GROUP BY 1)
SELECT span_id, place, depth, size FROM flat JOIN below USING (span_id) WHERE place BETWEEN 100 AND 399""",
    "heap_root_path": "WITH RECURSIVE " + SPAN + """, up AS (SELECT span_id AS id, span_id AS spot, 0 AS steps FROM span WHERE parent_span_id IS NOT NULL
  UNION ALL SELECT u.id, s.parent_span_id, u.steps + 1 FROM up u JOIN span s ON s.span_id = u.spot WHERE s.parent_span_id IS NOT NULL AND u.steps < 11)
SELECT id, max(steps)::INT AS steps, arg_max(spot, steps) AS top FROM up GROUP BY id""",
    "cpu_functions": f"""{_TREE}, s AS (SELECT span_id AS id, service, round((end_ms - start_ms) * 1000)::BIGINT AS us FROM span), t AS (SELECT w.id, sum(s.us) AS total FROM walk w JOIN s ON s.id = w.to_id GROUP BY w.id)
SELECT s.id, service AS function, 1::BIGINT AS hits, round(us / 1000.0::DOUBLE, 6) AS self_ms, round(total / 1000.0::DOUBLE, 6) AS total_ms, round(CASE WHEN total > 0 THEN us / total::DOUBLE * 100 ELSE 0 END, 6) AS self_percent,
  round(total / (SELECT sum(us) FROM s)::DOUBLE * 100, 6) AS total_percent FROM s JOIN t USING (id)""",
}
