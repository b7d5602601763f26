"""DuckDB SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS win FROM p),
m AS (SELECT win, min(doc_id) AS least FROM x WHERE win IS NOT NULL GROUP BY win),
f AS (SELECT doc_id, i, word, coalesce(least < doc_id, false) AS hit FROM x LEFT JOIN m USING (win)),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

NGRAM_JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS spot FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.spot),
c AS (SELECT id, min(spot) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id"""

DECONTAMINATION = rf"""WITH b AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM b),
s AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' .' ELSE '' END AS s FROM (SELECT side, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY 1),
o AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, c AS n_shared, c::DOUBLE / n AS containment FROM o JOIN n ON n.id = item_id WHERE 100 * c >= 75 * n"""

FILTER_AUDIT = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY 1),
b AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < t.doc_id, false)}} AS x FROM t JOIN m USING (text) LEFT JOIN b ON b.doc_id = t.doc_id),
f AS (SELECT part, good, toxic, list_filter([CASE WHEN x.A THEN 'A' END, CASE WHEN x.B THEN 'B' END, CASE WHEN x.C THEN 'C' END, CASE WHEN x.D THEN 'D' END, CASE WHEN x.E THEN 'E' END], lambda q: q IS NOT NULL) AS fails FROM d),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, list_transform(range(1, step), lambda i: filter_order[i]) AS past FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN NOT list_has_any(fails, past) AND NOT list_contains(fails, own) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN NOT list_has_any(fails, past) AND list_contains(fails, own) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN list_has_any(fails, past) AND list_contains(fails, own) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = [own] THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT list_has_any(fails, past) AND list_contains(fails, own) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN NOT list_has_any(fails, past) AND list_contains(fails, own) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT html, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY 1),
x AS (SELECT page_id, n, sha256(p.html) AS d, CASE WHEN least < page_id THEN least END AS least FROM p LEFT JOIN m ON m.html = p.html)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN least IS NULL THEN 'response' ELSE 'revisit' END AS record_type, least AS refers_to FROM x"""
