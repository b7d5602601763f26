"""The filter audit against brute force."""

from collections import Counter
from itertools import permutations

from tracequill.llm import queries
from tracequill.llm.filter_audit import audit_filters

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_audit(docs, labels):
    """{(part, order, step): counts}; docs: [(id, text, source)], labels: [(id, quality, toxic)]."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = Counter(), Counter()
    parts = {s or "" for _, _, s in docs}
    for i, t, s in docs:
        t, s = t or "", s or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i,
        }
        for order in permutations("ABCDE"):
            name, gone = "".join(order), False
            for k, f in enumerate(order, 1):
                at = (s, name, k)
                out[at, "redundant"] += gone and fails[f]
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                if not gone and fails[f]:
                    gone = True
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += i in good
                    out[at, "toxic_lost"] += i in toxic
                    shapley[s, f] += 1
                out[at, "kept"] += not gone
    return {(s, "".join(o), k): (*(out[(s, "".join(o), k), c] for c in FIELDS[:-1]), shapley[s, f]) for s in parts for o in permutations("ABCDE") for k, f in enumerate(o, 1)}


def rows_of(frame):
    rows = frame.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in rows}
    assert len(rows) == len(got)
    return got


def test_op13_equals_brute_force(spark, tables):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    assert rows_of(queries.op13_filter_audit(spark, tables)) == brute_audit(docs, labels)


def test_op13_odd_rows(spark):
    prose, noise = " ".join(f"w{i}" for i in range(60)), "A LOUD # " * 20
    docs = [
        (5, prose, "x"), (3, prose, "y"), (3, prose, "x"), (3, prose, "x"), (None, prose, "x"), (None, prose, None), (None, "own", ""), (7, None, "x"),
        (8, "", None), (1, noise, "x"), (2, noise, "x"), (2, noise, "x"), (9, "x " * 30_000, "y"), (10, " É" * 40, "y"), (11, "ÀB" * 9, "y"), (12, " \t", "z"),
    ]
    labels = [(3, 1, 0), (3, 0, 1), (2, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, None)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, mask int, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(frame, marks)) == brute_audit(docs, labels)


def test_op13_without_labels_or_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(i, f"text {i % 2}", "s") for i in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows_of(audit_filters(frame, marks)) == brute_audit(docs, [])
    assert audit_filters(frame.filter("false"), marks).count() == 0
