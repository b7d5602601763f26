"""Queries over a compiler log made of the driver's events: ten logs, a line an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jit
from .bridge import raw


def lines(spark, d):
    e = F.col("event_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    site = text("app.js:", F.col("user_id") % 5, ":", e % 3)
    at = text("0x2c", e % 4)
    info = text(at, " <SharedFunctionInfo fn", e % 4, ">")
    ic = text("  LoadIC[0] (0x1c) at ", site, " offset ", e % 90, ": [key: k", e % 4, "] map 0xa", (e / 10).cast("long") % 7, " 0xa", (e / 10).cast("long") % 2, F.when(e % 11 == 0, " generic").otherwise(""))
    opt = (
        F.when(e % 16 < 4, text("[marking ", info, " for optimized recompilation, reason: Small]")).when(e % 16 < 8, text("[compiling method ", info, " using TurboFan] OSR"))
        .when(e % 16 < 15, text("[optimizing ", info, " - took 0.25 ms]")).otherwise(text("[disabled optimization for ", info, ", reason: NeverOptimize]"))
    )
    moved = text("Map transition from 0xa", e % 5, " to 0xb", e % 3, ' for "p', e % 2, '" at ', site)
    begin = text("[deoptimizing (DEOPT eager): begin ", at, " <fn", e % 4, "> at ", site, "]")
    other = F.when((e / 10).cast("long") % 2 == 0, text("[bailout (kind: deopt-lazy, reason: why ", e % 6, ")]")).otherwise(text("[deoptimizing (DEOPT eager): end ", at, " <fn", e % 4, ">]"))
    kind = F.col("event_type")
    line = F.when(kind == "click", ic).when(kind == "view", moved).when(kind == "signup", opt).when(kind == "purchase", begin).otherwise(other)
    return raw(spark, d).select((e % 10).alias("series"), e.alias("seq"), line.alias("line"))


def _all(spark, d):
    events = jit.parse(lines(spark, d))
    return events, jit.sites(events), jit.functions(events)


def jit_events(spark, d):
    rows = jit.parse(lines(spark, d))
    return rows.select("series", "seq", "class", "kind", "site", "offset", "key", "state", F.array_join("maps", " ").alias("maps"), "address", "target", "name", "reason", "compiler", "took_ms", "begins")


def jit_files(spark, d):
    return jit.log_files(jit.parse(lines(spark, d)))


def jit_sites(spark, d):
    return jit.sites(jit.parse(lines(spark, d))).select("series", "id", "hits", F.array_join("maps", " ").alias("maps"), F.array_join("keys", " ").alias("keys"), "state", "offset")


def jit_functions(spark, d):
    return jit.functions(jit.parse(lines(spark, d))).select("series", "id", "name", "opts", "deopts", "reopts", "compiler", "status", F.array_join("reasons", ",").alias("reasons"), F.col("burst").cast("long").alias("burst"))


def jit_graph(spark, d):
    events, found, _ = _all(spark, d)
    return jit.graph_edges(events, found)


def jit_graph_nodes(spark, d):
    events, found, _ = _all(spark, d)
    return jit.graph_nodes(events, found)


def jit_findings(spark, d):
    _, found, funcs = _all(spark, d)
    return jit.findings(found, funcs).withColumn("score", F.round("score", 9))


def jit_health(spark, d):
    _, found, funcs = _all(spark, d)
    return jit.health(jit.findings(found, funcs))


def jit_top(spark, d):
    _, found, funcs = _all(spark, d)
    a = jit.top_sites(found, 10).select("series", "id", F.col("hits").alias("n"))
    return a.unionByName(jit.top_functions(funcs, 10).select("series", "id", (F.col("opts") + F.col("deopts")).alias("n")))


def finding_functions(spark, d):
    """A finding per event, by line, name or file; a function per event, in three files, nested, equal and crossing."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = raw(spark, d).select("event_id", "user_id")
    files = rows.select((e % 3).alias("file_id")).distinct().withColumn("name", F.element_at(F.array(F.lit("dist/app.js"), F.lit("old\\lib.js"), F.lit("other.js")), F.col("file_id").cast("int") + 1))
    start = u * 13 % 3000
    functions = rows.select((e % 3).alias("file_id"), F.concat(F.lit("fn"), e % 50).alias("name"), start.alias("start_line"), (start + (e % 7) * (e % 200)).alias("end_line"), e.alias("seq"))
    target = (
        F.when(e % 5 == 0, F.concat(F.lit("src/App.js:"), u % 4500, F.lit(":4"))).when(e % 5 == 1, F.concat(F.lit("fn"), e % 60))
        .when(e % 5 == 2, F.lit("lib.js")).when(e % 5 == 3, F.lit("gone.js:7")).otherwise(F.concat(F.lit("LIB.js:"), e % 4000))
    )
    return jit.in_sources(rows.select("event_id", target.alias("target")), files, functions)


QUERIES = {f.__name__: f for f in (jit_events, jit_files, jit_sites, jit_functions, jit_graph, jit_graph_nodes, jit_findings, jit_health, jit_top, finding_functions)}

_L = """l AS (SELECT event_id AS seq, event_id % 10 AS series, event_type AS t, event_id % 16 AS o, 'app.js:' || user_id % 5 || ':' || event_id % 3 AS st, '0x2c' || event_id % 4 AS ad, 'fn' || event_id % 4 AS fn, event_id // 10 AS j FROM events),
p AS (SELECT seq, series, CASE t WHEN 'click' THEN 'ic' WHEN 'view' THEN 'map' WHEN 'signup' THEN 'opt' WHEN 'purchase' THEN 'deopt' ELSE CASE WHEN j % 2 = 0 THEN 'bailout' ELSE 'deopt' END END AS class,
  CASE t WHEN 'click' THEN 'LoadIC' WHEN 'view' THEN 'transition' WHEN 'signup' THEN CASE WHEN o < 4 THEN 'marking' WHEN o < 8 THEN 'osr' WHEN o < 15 THEN 'optimized' ELSE 'disabled' END WHEN 'purchase' THEN 'eager' ELSE CASE WHEN j % 2 = 0 THEN 'lazy' ELSE 'eager' END END AS kind,
  CASE WHEN t IN ('click', 'view', 'purchase') THEN st END AS site, CASE WHEN t = 'click' THEN (seq % 90)::INT END AS "offset", CASE t WHEN 'click' THEN 'k' || seq % 4 WHEN 'view' THEN 'p' || seq % 2 END AS key,
  CASE WHEN t = 'click' THEN CASE WHEN seq % 11 = 0 THEN 'megamorphic' WHEN j % 7 = j % 2 THEN 'monomorphic' ELSE 'polymorphic' END END AS state,
  CASE WHEN t = 'click' THEN CASE WHEN j % 7 = j % 2 THEN '0xa' || j % 7 ELSE '0xa' || j % 7 || ' 0xa' || j % 2 END END AS maps,
  CASE WHEN t = 'view' THEN '0xa' || seq % 5 WHEN t IN ('signup', 'purchase') OR (t = 'error' AND j % 2 = 1) THEN ad END AS address, CASE WHEN t = 'view' THEN '0xb' || seq % 3 END AS target,
  CASE WHEN t IN ('signup', 'purchase') OR (t = 'error' AND j % 2 = 1) THEN fn END AS name, t = 'purchase' AS begins,
  CASE WHEN t = 'error' AND j % 2 = 0 THEN 'why ' || seq % 6 END AS why, CASE WHEN t = 'signup' THEN CASE WHEN o < 4 THEN 'Small' WHEN o < 8 THEN 'TurboFan' WHEN o < 15 THEN '0.25' ELSE 'NeverOptimize' END END AS third, t = 'error' AND j % 2 = 1 AS ends FROM l),
w AS (SELECT *, max(CASE WHEN why IS NOT NULL THEN seq END) OVER b AS ls, max(CASE WHEN ends THEN seq END) OVER b AS rs, min(CASE WHEN why IS NOT NULL THEN seq END) OVER a AS ns, min(CASE WHEN begins THEN seq END) OVER a AS ag FROM p
  WINDOW b AS (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
e AS (SELECT w.*, coalesce(w.why, third, CASE WHEN w.class = 'deopt' THEN coalesce(CASE WHEN rs IS NULL OR ls > rs THEN x.why END, CASE WHEN w.begins AND (ag IS NULL OR ns < ag) THEN y.why END) END) AS reason
  FROM w LEFT JOIN (SELECT series, seq, why FROM p) x ON x.series = w.series AND x.seq = ls LEFT JOIN (SELECT series, seq, why FROM p) y ON y.series = w.series AND y.seq = ns),
ic AS (SELECT *, 'LoadIC@' || site AS id FROM e WHERE class = 'ic'), mp AS (SELECT series, id, site, seq, unnest(string_split(maps, ' ')) AS m, generate_subscripts(string_split(maps, ' '), 1) AS o FROM ic),
si AS (SELECT series, id, any_value(site) AS site, count(*) AS hits, arg_min("offset", seq) AS "offset", min(seq) AS fs FROM ic GROUP BY 1, 2),
sm AS (SELECT series, id, count(*) AS nm FROM (SELECT DISTINCT series, id, m FROM mp) GROUP BY 1, 2),
fe AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY series, address ORDER BY seq RANGE BETWEEN 40 PRECEDING AND CURRENT ROW) AS bu, min(CASE WHEN kind IN ('optimized', 'osr') THEN seq END) OVER (PARTITION BY series, address) AS fo FROM e WHERE class = 'opt' OR begins),
fu AS (SELECT series, address AS id, any_value(name) AS name, count(*) FILTER (WHERE kind IN ('optimized', 'osr')) AS opts, count(*) FILTER (WHERE begins) AS deopts,
  least(count(*) FILTER (WHERE kind IN ('optimized', 'osr')), count(*) FILTER (WHERE begins AND seq > fo)) AS reopts, CASE WHEN bool_or(kind = 'osr') THEN 'TurboFan' END AS compiler,
  coalesce(arg_max(CASE WHEN reason = 'NeverOptimize' THEN 'never' ELSE 'optimized' END, seq) FILTER (WHERE kind IN ('optimized', 'osr', 'disabled')), 'none') AS status, coalesce(max(bu) FILTER (WHERE begins), 0) AS burst FROM fe GROUP BY 1, 2),
rr AS (SELECT series, address AS id, reason, kind, class, seq, row_number() OVER (PARTITION BY series, address, reason ORDER BY class DESC, seq) AS nth FROM fe WHERE reason IS NOT NULL AND (begins OR kind IN ('marking', 'disabled'))),
rs AS (SELECT series, id, string_agg(reason, ',' ORDER BY class DESC, seq) AS reasons FROM rr WHERE nth = 1 OR kind = 'disabled' GROUP BY 1, 2),
fd AS (SELECT series, 'megamorphic-ic' AS rule, site AS target, least(1, (nm - 4) / 4.0::DOUBLE) AS score FROM si JOIN sm USING (series, id) WHERE nm > 4
  UNION ALL SELECT series, 'deopt-storm', name, least(1, burst / 10.0::DOUBLE) FROM fu WHERE deopts > 0 AND burst >= 3 UNION ALL SELECT series, 'deopt-loop', name, least(1, 0.4 + reopts * 0.05) FROM fu WHERE deopts > 0 AND reopts >= 2
  UNION ALL SELECT series, 'hidden-class-fragmentation', ln, least(1, count(*) / 8.0::DOUBLE) FROM (SELECT DISTINCT series, split_part(site, ':', 1) || ':' || split_part(site, ':', 2) AS ln, m FROM mp) GROUP BY series, ln HAVING count(*) > 3
  UNION ALL SELECT series, 'optimization-suppressed', name, 0.8 FROM fu WHERE status IN ('never', 'disabled'))"""

ORACLE_SQL = {
    "jit_events": f"""WITH {_L} SELECT series, seq, class, kind, site, "offset", key, state, maps, address, target, name, reason, CASE WHEN class = 'opt' AND third <> '0.25' THEN third END AS compiler,
CASE WHEN kind = 'optimized' THEN 0.25::DOUBLE END AS took_ms, begins FROM e""",
    "jit_files": f"WITH {_L} SELECT DISTINCT series, 'app.js' AS file FROM e WHERE site IS NOT NULL",
    "jit_sites": f"""WITH {_L}, a AS (SELECT series, id, string_agg(m, ' ' ORDER BY s, o) AS maps, count(*) AS n FROM (SELECT series, id, m, min(seq) AS s, min(seq * 2 + o) AS o FROM mp GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT series, id, string_agg(key, ' ' ORDER BY s) AS keys FROM (SELECT series, id, key, min(seq) AS s FROM ic GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT series, id, hits, maps, keys, CASE WHEN n = 1 THEN 'monomorphic' WHEN n <= 4 THEN 'polymorphic' ELSE 'megamorphic' END AS state, "offset" FROM si JOIN a USING (series, id) JOIN b USING (series, id)""",
    "jit_functions": f"WITH {_L} SELECT series, id, name, opts, deopts, reopts, compiler, status, coalesce(reasons, '') AS reasons, burst FROM fu LEFT JOIN rs USING (series, id)",
    "jit_graph": f"""WITH {_L} SELECT DISTINCT series, id AS source, m AS target, 'observed' AS kind, NULL::VARCHAR AS property, 1::BIGINT AS weight FROM mp
UNION ALL SELECT series, address, target, 'transition', arg_min(key, seq), count(*) FROM e WHERE class = 'map' GROUP BY 1, 2, 3""",
    "jit_graph_nodes": f"""WITH {_L} SELECT series, id, 'site' AS type, hits AS count FROM si UNION ALL SELECT series, m, 'map', sum(n)::BIGINT FROM (SELECT series, m, 1 AS n FROM mp UNION ALL SELECT series, address, 0 FROM e WHERE class = 'map' UNION ALL SELECT series, target, 0 FROM e WHERE class = 'map') GROUP BY 1, 2""",
    "jit_findings": f"""WITH {_L} SELECT series, rule, target, round(score, 9) AS score, CASE WHEN rule IN ('deopt-loop', 'optimization-suppressed') THEN 'warning' WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.35 THEN 'warning' ELSE 'info' END AS severity FROM fd""",
    "jit_health": f"WITH {_L} SELECT series, round(greatest(0, least(1, 1 - sum(score) * 0.12)), 9) AS health FROM fd GROUP BY 1",
    "jit_top": f"""WITH {_L} (SELECT series, id, hits AS n FROM si ORDER BY hits DESC, series, fs LIMIT 10) UNION ALL (SELECT series, id, opts + deopts FROM fu ORDER BY opts + deopts DESC, series, id LIMIT 10)""",
    "finding_functions": """WITH v AS (SELECT event_id AS e, user_id AS u FROM events),
f AS (SELECT DISTINCT e % 3 AS file_id, CASE e % 3 WHEN 0 THEN 'dist/app.js' WHEN 1 THEN 'old\\lib.js' ELSE 'other.js' END AS name FROM v),
fn AS (SELECT e % 3 AS file_id, 'fn' || (e % 50) AS name, u * 13 % 3000 AS a, u * 13 % 3000 + (e % 7) * (e % 200) AS b, e AS seq FROM v),
t AS (SELECT e, CASE e % 5 WHEN 0 THEN 'src/App.js:' || (u % 4500) || ':4' WHEN 1 THEN 'fn' || (e % 60) WHEN 2 THEN 'lib.js' WHEN 3 THEN 'gone.js:7' ELSE 'LIB.js:' || (e % 4000) END AS target,
  CASE e % 5 WHEN 0 THEN u % 4500 WHEN 4 THEN e % 4000 END AS line, CASE e % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 1 THEN (SELECT min(file_id) FROM fn WHERE fn.name = 'fn' || (e % 60)) END AS file_id FROM v),
l AS (SELECT file_id, line, arg_max(fn.name, (b - a, -seq)) AS function FROM (SELECT DISTINCT file_id, line FROM t WHERE line IS NOT NULL) x JOIN fn USING (file_id) WHERE line BETWEEN a AND b GROUP BY 1, 2),
n AS (SELECT DISTINCT file_id, name FROM fn)
SELECT e AS event_id, target, f.name AS file, coalesce(l.function, n.name) AS function, CASE WHEN f.name IS NULL THEN 'none' WHEN coalesce(l.function, n.name) IS NULL THEN 'file' ELSE 'function' END AS scope
FROM t LEFT JOIN f USING (file_id) LEFT JOIN l ON l.file_id = t.file_id AND l.line = t.line LEFT JOIN n ON n.file_id = t.file_id AND t.line IS NULL AND n.name = t.target""",
}
