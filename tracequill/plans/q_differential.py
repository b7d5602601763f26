"""Queries over pairs of runs: each user's events, and the same with changed contexts, errors and missing ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import canonical_map
from ..operators import differential as dif
from .bridge import EV, trace_events
from .stages import saved

PAIR = "user_id"


def runs(spark, d):
    """(normal, fault): in the fault run every 37th operation has another context, every second of these
    an error, every third lasts 5 ms longer, and every fifth user's last event is missing."""
    normal = trace_events(spark, d)
    op = F.floor(F.col("seq") / 2)
    last = normal.groupBy(PAIR).agg(F.max(F.struct("ts_ms", "channel", "seq")).alias("last"))
    fault = normal.join(last, PAIR).filter((F.col(PAIR) % 5 != 0) | (F.col("seq") != F.col("last.seq"))).drop("last")
    fault = fault.withColumn("context_json", F.when(op % 37 == 0, '{"k": -1}').otherwise(F.col("context_json")))
    failed = (op % 74 == 0) & (F.col("event_type") == "end")
    fault = fault.withColumn("error_message", F.when(failed, "boom").otherwise(F.col("error_message")))
    fault = fault.withColumn("error_stack", F.when(failed, "Error: boom\n    at run (/app/a.js:1:2)"))
    return normal, fault.withColumn("duration_ms", F.when(op % 3 == 0, F.col("duration_ms") + 5).otherwise(F.col("duration_ms")))


def _normal(spark, d):
    return tuple(saved(dif.normalise(x, PAIR)) for x in runs(spark, d))


def _points(spark, d):
    a, b = _normal(spark, d)
    return dif.divergences(dif.event_diffs(dif.align(a, b, PAIR), a, b, PAIR), PAIR)


def normalised_runs(spark, d):
    rows = dif.normalise(runs(spark, d)[1], PAIR)
    return rows.select(PAIR, F.col("i").cast("long").alias("i"), F.round("rel_ms", 3).alias("rel_ms"), "signature", "fingerprint")


def alignment(spark, d):
    return dif.align(*_normal(spark, d), PAIR)


def alignment_summary(spark, d):
    return dif.alignment_summary(dif.align(*_normal(spark, d), PAIR), PAIR).withColumn("similarity", F.round("similarity", 9))


def scattered_alignment(spark, d):
    """The whole table as one run, and the same with the context of every 97th operation changed."""
    normal = trace_events(spark, d).withColumn("pair", F.lit(0))
    fault = normal.withColumn("context_json", F.when(F.floor(F.col("seq") / 2) % 97 == 5, '{"k": -1}').otherwise(F.col("context_json")))
    pairs = dif.align(dif.normalise(normal, "pair"), dif.normalise(fault, "pair"), "pair")
    return dif.alignment_summary(pairs, "pair").withColumn("similarity", F.round("similarity", 9))


def one_pair_alignment(spark, d):
    """The whole table as one run, and the same with the context of its middle operation changed."""
    normal = trace_events(spark, d).withColumn("pair", F.lit(0))
    middle = normal.agg(F.max(F.floor(F.col("seq") / 4)).alias("middle"))
    fault = normal.join(F.broadcast(middle), how="cross")  # one row
    fault = fault.withColumn("context_json", F.when(F.floor(F.col("seq") / 2) == F.col("middle"), '{"k": -1}').otherwise(F.col("context_json")))
    pairs = dif.align(dif.normalise(normal, "pair"), dif.normalise(fault, "pair"), "pair")
    return dif.alignment_summary(pairs, "pair").withColumn("similarity", F.round("similarity", 9))


def event_diffs(spark, d):
    a, b = _normal(spark, d)
    rows = dif.event_diffs(dif.align(a, b, PAIR), a, b, PAIR)
    value = F.get("value_diffs", 0)
    return rows.select(
        PAIR, "normal_index", "fault_index", F.col("diff_kind").alias("kind"), "significance", F.size("value_diffs").cast("long").alias("n_values"), F.size("stack_diffs").cast("long").alias("n_stack"),
        value["change"].alias("change"), value["before"].alias("before"), value["after"].alias("after"), F.get("stack_diffs", 1)["after"].alias("frame"),
    )


def divergences(spark, d):
    rows = _points(spark, d)
    return rows.select(PAIR, F.col("order").cast("long").alias("order"), "kind", "normal_index", "fault_index", "role", "reason", F.round("confidence", 6).alias("confidence"), "significance", "description", "size", "low_normal", "low_fault")


def first_divergence(spark, d):
    return dif.first_divergence(_points(spark, d)).select(PAIR, "kind", "normal_index", "fault_index", "role")


def _semantic(spark, d):
    """Noise: the second and third event of every even user."""
    even = trace_events(spark, d).filter(F.col(PAIR) % 2 == 0).select(PAIR).distinct()
    noise = even.withColumn("first", F.lit(1)).withColumn("last", F.lit(2))
    return dif.semantic(_points(spark, d), PAIR, noise, noise)


def semantic_divergences(spark, d):
    rows = _semantic(spark, d)
    return rows.select(PAIR, F.col("order").cast("long").alias("order"), "kind", "channel", "operation_id", F.round("delta_ms", 6).alias("delta_ms"), "path_changed", "significance")


def channel_regressions(spark, d):
    return dif.channel_regressions(_semantic(spark, d), PAIR).withColumn("delta_ms", F.round("delta_ms", 6))


def regression_score(spark, d):
    rows = dif.regression_score(_semantic(spark, d), PAIR)
    return rows.select(PAIR, *(F.round(c, 6).alias(c) for c in ("severity", "confidence", "impact", "total_delta_ms")), "channels")


def run_report(spark, d):
    a, b = _normal(spark, d)
    pairs = saved(dif.align(a, b, PAIR))
    return dif.run_report(dif.alignment_summary(pairs, PAIR), dif.divergences(dif.event_diffs(pairs, a, b, PAIR), PAIR), PAIR)


def canonical_values(spark, d):
    """Canonical texts of contexts of several types."""
    rows = trace_events(spark, d)
    made = F.concat(F.lit('{"b": ['), F.col("seq"), F.lit(', true, null], "a": {"z": "x", "y": '), F.round("duration_ms", 6), F.lit('}, "n": null}'))
    return rows.select("seq", F.explode(canonical_map(made)).alias("key", "text")).filter("key <> 'a' OR seq % 2 = 0").select("seq", "key", F.when(F.col("key") == "a", F.length(F.regexp_extract("text", '^object:\\{"y":number:', 0)).cast("string")).otherwise(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        normalised_runs, alignment, alignment_summary, one_pair_alignment, scattered_alignment, event_diffs, divergences, first_divergence, semantic_divergences,
        channel_regressions, regression_score, run_report, canonical_values,
    )
}

_RUNS = EV + """,
a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, seq // 2 AS op FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, channel, seq)),
b AS (SELECT *, CASE WHEN op % 37 = 0 THEN '{"k": -1}' ELSE context_json END AS context2, op % 74 = 0 AND event_type = 'end' AS boom,
  CASE WHEN op % 3 = 0 THEN duration_ms + 5 ELSE duration_ms END AS duration2, user_id % 5 = 0 AND i = n - 1 AS gone FROM a),
p AS (SELECT *, CASE WHEN gone THEN 'delete' WHEN op % 37 = 0 THEN 'substitute' ELSE 'match' END AS kind FROM b),
q AS (SELECT *, coalesce(min(CASE WHEN kind <> 'match' THEN i END) OVER u, n) AS pre, n - 1 - coalesce(max(CASE WHEN kind <> 'match' THEN i END) OVER u, -1) AS suf FROM p WINDOW u AS (PARTITION BY user_id)),
al AS (SELECT *, CASE WHEN i < pre OR i < n - suf THEN i ELSE n - suf + (n - 1 - i) END AS place, CASE WHEN gone THEN -1 ELSE i END AS fi, CASE kind WHEN 'delete' THEN 2 WHEN 'substitute' THEN 1 ELSE 0 END AS cost FROM q),
df AS (SELECT *, boom AND error_message IS NULL AND NOT gone AS intro,
  CASE WHEN boom AND NOT gone THEN 'error-introduced' WHEN gone THEN 'event-missing' ELSE 'event-value-change' END AS dk FROM al WHERE kind <> 'match'),
sg AS (SELECT *, CASE dk WHEN 'error-introduced' THEN 1.0::DOUBLE WHEN 'event-missing' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS sig, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS region FROM df),
rg AS (SELECT user_id, region, count(*) AS size, min(i) AS at_i, bool_or(intro) AS introduces, coalesce(min(i) FILTER (WHERE intro), min(i)) AS rep_i,
  min(fi) FILTER (WHERE fi >= 0) AS low_fault FROM sg GROUP BY ALL),
pt AS (SELECT rg.*, s.dk, s.sig, s.channel, s.event_type, s.fi AS rep_f, s.operation_id, s.gone, s.duration2 - s.duration_ms AS delta, f.dk AS first_dk, f.channel AS first_channel, f.fi AS first_f,
  row_number() OVER (PARTITION BY rg.user_id ORDER BY at_i) - 1 AS r, first_value(f.channel) OVER (PARTITION BY rg.user_id ORDER BY at_i) AS prim
  FROM rg JOIN sg s ON s.user_id = rg.user_id AND s.i = rg.rep_i JOIN sg f ON f.user_id = rg.user_id AND f.i = rg.at_i),
dv AS (SELECT *, r + 1 AS "order", CASE WHEN r = 0 THEN 'cause' WHEN first_channel = prim OR introduces THEN 'effect' ELSE 'ambiguous' END AS role,
  CASE WHEN r = 0 AND introduces THEN 'the first event where the fault run raises an error the normal run does not'
    WHEN r = 0 THEN 'the first event where the two runs diverge (' || replace(first_dk, '-', ' ') || ')'
    WHEN first_channel = prim THEN 'same channel as the primary divergence — a downstream symptom'
    WHEN introduces THEN 'error surfaced downstream of the original divergence'
    WHEN first_f >= 0 THEN 'independent divergence not on the primary channel' ELSE 'structural difference with unclear causality' END AS reason,
  least(1, greatest(0, CASE WHEN dk IN ('error-introduced', 'event-missing') THEN greatest(sig, 0.85) ELSE sig END + least(0.15, size * 0.03) - least(0.3, r * 0.05))) AS conf,
  CASE dk WHEN 'error-introduced' THEN 'the fault run threw an error' WHEN 'event-missing' THEN 'the fault run skipped an event that the normal run executed' ELSE 'an event ran with different variable values' END
    || CASE WHEN size > 1 THEN ' (' || size || ' consecutive differing events)' ELSE '' END || '. normal: ' || channel || ' ' || event_type || ' context {k} vs '
    || CASE WHEN gone THEN 'fault: (none)' ELSE 'fault: ' || channel || ' ' || event_type || ' context {k}' END AS description FROM pt),
se AS (SELECT * FROM dv WHERE NOT (user_id % 2 = 0 AND (rep_i BETWEEN 1 AND 2 OR rep_f BETWEEN 1 AND 2))),
cr AS (SELECT user_id, channel, sum(CASE WHEN gone THEN 0 ELSE delta END) AS delta_ms, count(*) AS n, bool_or(dk = 'error-introduced') AS error_introduced, bool_or(dk IN ('error-introduced', 'event-missing')) AS path_changed
  FROM se GROUP BY ALL HAVING sum(CASE WHEN gone THEN 0 ELSE delta END) <> 0 OR bool_or(dk IN ('error-introduced', 'event-missing')))"""
_SCORE = """, t AS (SELECT user_id, greatest(0.2, count(*) FILTER (WHERE dk IN ('error-introduced', 'event-missing'))::DOUBLE / count(*)) AS confidence, avg(sig) AS mean FROM se GROUP BY 1),
c AS (SELECT user_id, count(*) AS channels, sum(delta_ms) AS total FROM cr GROUP BY 1),
m AS (SELECT t.*, coalesce(channels, 0) AS channels, coalesce(total, 0) AS total, least(1, mean * (0.6 + 0.4 * least(1, coalesce(channels, 0) / 3.0::DOUBLE))) AS impact FROM t LEFT JOIN c USING (user_id))"""
_KEY = """'{"k":number:' || json_extract_string(context2, '$.k') || '}'"""

ORACLE_SQL = {
    "normalised_runs": f"""WITH {_RUNS} SELECT user_id, row_number() OVER w - 1 AS i, round(ts_ms - first_value(ts_ms) OVER w, 3) AS rel_ms, channel || '|' || event_type AS signature, channel || '|' || event_type || '|' || {_KEY} AS fingerprint
FROM b WHERE NOT gone WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, channel, seq)""",
    "alignment": f"WITH {_RUNS} SELECT user_id, place, i AS normal_index, fi AS fault_index, kind, cost FROM al",
    "alignment_summary": f"WITH {_RUNS} SELECT user_id, sum(cost)::BIGINT AS cost, count(*) FILTER (WHERE kind <> 'match') AS edits, count(*) FILTER (WHERE kind = 'match') AS matches, round(count(*) FILTER (WHERE kind = 'match')::DOUBLE / count(*), 9) AS similarity FROM al GROUP BY 1",
    "one_pair_alignment": f"""WITH {EV}, m AS (SELECT max(seq // 4) AS m FROM ev) SELECT 0 AS pair, count(*) FILTER (WHERE seq // 2 = m)::BIGINT AS cost, count(*) FILTER (WHERE seq // 2 = m) AS edits, count(*) FILTER (WHERE seq // 2 <> m) AS matches,
round(count(*) FILTER (WHERE seq // 2 <> m)::DOUBLE / count(*), 9) AS similarity FROM ev, m""",
    "scattered_alignment": f"""WITH {EV} SELECT 0 AS pair, count(*) FILTER (WHERE seq // 2 % 97 = 5)::BIGINT AS cost, count(*) FILTER (WHERE seq // 2 % 97 = 5) AS edits, count(*) FILTER (WHERE seq // 2 % 97 <> 5) AS matches,
round(count(*) FILTER (WHERE seq // 2 % 97 <> 5)::DOUBLE / count(*), 9) AS similarity FROM ev""",
    "event_diffs": f"""WITH {_RUNS} SELECT user_id, i AS normal_index, fi AS fault_index, dk AS kind, sig AS significance, 1 AS n_values, CASE WHEN boom AND NOT gone THEN 2 ELSE 0 END AS n_stack,
CASE WHEN gone THEN 'removed' ELSE 'changed' END AS change, json_extract_string(context_json, '$.k') AS before, CASE WHEN NOT gone THEN '-1' END AS after, CASE WHEN boom AND NOT gone THEN 'at run (/app/a.js:1:2)' END AS frame FROM sg""",
    "divergences": f"""WITH {_RUNS} SELECT user_id, "order", dk AS kind, rep_i AS normal_index, rep_f AS fault_index, role, reason, round(conf, 6) AS confidence, sig AS significance, description, size, at_i AS low_normal, coalesce(low_fault, -1) AS low_fault FROM dv""",
    "first_divergence": f"WITH {_RUNS} SELECT user_id, dk AS kind, rep_i AS normal_index, rep_f AS fault_index, role FROM dv WHERE r = 0",
    "semantic_divergences": f"""WITH {_RUNS} SELECT user_id, "order", dk AS kind, channel, operation_id, round(CASE WHEN gone THEN 0 ELSE delta END, 6) AS delta_ms, dk IN ('error-introduced', 'event-missing') AS path_changed, sig AS significance FROM se""",
    "channel_regressions": f"WITH {_RUNS} SELECT user_id, channel, round(delta_ms, 6) AS delta_ms, n, error_introduced, path_changed FROM cr",
    "regression_score": f"WITH {_RUNS} {_SCORE} SELECT user_id, round(least(1, confidence * impact), 6) AS severity, round(confidence, 6) AS confidence, round(impact, 6) AS impact, round(total, 6) AS total_delta_ms, channels FROM m",
    "run_report": f"""WITH {_RUNS}, l AS (SELECT user_id, string_agg("order" || '. [' || role || ', ' || round(conf * 100)::INT || '% sure] ' || description || ' (' || reason || ')', chr(10) ORDER BY "order") AS lines FROM dv GROUP BY 1),
s AS (SELECT user_id, count(*) FILTER (WHERE kind = 'match')::DOUBLE / count(*) AS sim FROM al GROUP BY 1)
SELECT user_id, printf('The runs are %.1f%% alike.', sim * 100) || chr(10) || coalesce(lines, 'No divergence was found.') AS report FROM s LEFT JOIN l USING (user_id)""",
    "canonical_values": f"""WITH {EV} SELECT seq, 'b' AS key, 'array:[number:' || seq || ',boolean:true,null]' AS text FROM ev UNION ALL SELECT seq, 'n', 'null' FROM ev UNION ALL SELECT seq, 'a', '19' FROM ev WHERE seq % 2 = 0""",
}
