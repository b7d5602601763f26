"""Substring dedup, the n-gram join and its components, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequill.llm import ngram_join, queries
from tracequill.llm.components import components
from tracequill.llm.ngram_join import class_keys, missable, near_components
from tracequill.llm.substring_dedup import dedup_substrings


def brute_repeats(docs, window):
    """{doc_id: (words, removed, sha256 of what stays)}; docs: [(id, text)]."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def brute_components(docs, width=5, percent=75):
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    sets = {}
    for i, t in docs:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op1_equals_brute_force(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, tables).collect()}
    assert got == brute_repeats(docs, 50)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    for window in (5, 8):
        out = dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window)
        got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in out.withColumn("s", F.sha2("kept_text", 256)).collect()}
        assert got == brute_repeats(docs, window)


def test_repeats_in_odd_rows(spark, odd_docs):
    out = dedup_substrings(odd_docs, 50)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept_text", "spans"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {(r.doc_id, r.lang, r.n_words): r for r in rows}
    assert by[1, "en", 120].n_removed == 0 and by[2, "en", 120].n_removed == 120 and by[2, "en", 120].spans == [[0, 120]]
    assert by[7, "en", 124].n_removed == 120 and by[7, "en", 124].kept_text == "tail of its own"
    assert by[None, "en", 120].n_removed == 0 and by[9, "en", 3000].n_removed == 0
    assert by[3, None, 0].kept_text == by[4, "de", 0].kept_text == by[5, "fr", 0].kept_text == ""
    assert dedup_substrings(odd_docs.limit(0)).count() == 0


def test_op3_equals_brute_force(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, tables).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("frequent", [3, 1000])
def test_components_at_random(spark, frequent):
    """Chains of copies with a few words changed, around one passage that all texts hold."""
    rng = random.Random(frequent)
    passage = [f"p{i}" for i in range(25)]
    docs = []
    for _ in range(12):
        base = passage + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 8, 40]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            base = copy if rng.random() < 0.5 else base
            docs.append((len(docs), " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(frame, frequent=frequent).collect()}
    assert got == brute_components(docs)


def test_components_of_odd_rows(spark, odd_docs):
    rows = near_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[2] == {(116, 1)} and by[7] == {(120, 1)}
    assert by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[6] == {(1, 6)}
    assert by[None] == {(116, None)} and len(by[10]) == 2
    assert near_components(odd_docs.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    top = {x: x for p in links for x in p}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        top[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize("n, step", [(1_000, 1), (1_000, -1), (100_000, 1)])
def test_components_of_ordered_chains(spark, n, step):
    links = spark.range(n).select((F.col("id") * step).alias("a"), ((F.col("id") + 1) * step).alias("b"))
    got = components(links).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(min(0, n * step), n + 1)]


def test_links_of_a_document_with_several_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(200))
    rows = [(3, a), (10, a), (10, b), (12, b + " tail"), (20, ""), (20, b), (21, "")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 56): 3, (10, 56): 3, (10, 196): 3, (12, 197): 3, (20, 0): 3, (20, 196): 3, (21, 0): 21}


def test_frequent_tokens_give_linear_keys_that_meet():
    """Two sets of frequent tokens over the threshold share a key, and a set has at most about two keys a token."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 30, 200, 2_000, 20_000):
        for _ in range(60 if n < 300 else 3):
            x = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            gone = int(rng.integers(0, missable(n, 75) + 1))
            m = n - gone
            more = int(rng.integers(0, max(0, (4 * m) // 3 - n) + 1))
            y = np.concatenate([x[gone:], rng.choice(1 << 40, more, replace=False).astype(np.uint64) + np.uint64(1 << 41)])
            keys = [class_keys(x, n, 0, 75), class_keys(y, len(y), 0, 75)]
            assert len(keys[0]) <= 2 * n + 8
            if 100 * m >= 75 * (n + more):
                assert len(np.intersect1d(*keys))


def test_long_near_copies_of_frequent_text(spark):
    """Near copies of 20,000 words, among many that hold the same passage."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(20_000)]
    docs = []
    for i in range(24):
        copy = list(base)
        for _ in range(rng.choice([0, 40, 300])):
            copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    docs += [(100 + i, " ".join(base[:200] + [f"u{i}-{k}" for k in range(rng.choice([20, 40, 400]))])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), frequent=3).collect()}
    assert got == brute_components(docs)


def test_marks_tell_apart_and_lose_no_similar_pair(spark):
    """Pairs by marks: all that are similar enough, and few of those that share a passage alone."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(120):  # copies with more and more words replaced, in runs
        words, at, n = list(base), int(rng.integers(0, 300)), 2 * (k % 60)
        for i in range(n):
            words[(at + i) % 300] = f"own{k}x{i}"
        texts.append(" ".join(words))
    texts += ["", "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["sid", "text"])
    tokens, off = ngram_join._sets(batch, 5)
    sets = [set(tokens[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    marks = pa.Table.from_batches(ngram_join._marked(iter([batch]), 5)).column("mark").to_pylist()
    rows = spark.createDataFrame([(k, len(s), m) for k, (s, m) in enumerate(zip(sets, marks, strict=True))], "a long, n long, m array<long>")
    both = rows.crossJoin(rows.toDF("b", "o", "p")).filter("a < b")
    passed = {(r.a, r.b) for r in both.filter(ngram_join.near("n", "o", "m", "p", 75)).select("a", "b").collect()}
    similar, shared = set(), 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            meet = len(sets[a] & sets[b])
            shared += meet > 0
            if meet and 100 * meet >= 75 * len(sets[a] | sets[b]):
                similar.add((a, b))
    assert similar <= passed
    assert len(similar) > 100 and len(passed) - len(similar) < (shared - len(similar)) / 4


@pytest.mark.parametrize("exact", [False, True])
def test_a_range_of_hashes_is_settled_in_steps(exact):
    """Memory follows the hashes themselves, not all that sorting them at once takes; what goes back is as brute force has it."""
    import tracemalloc

    from tracequill.llm import substring_dedup

    rng = np.random.default_rng(8)
    rows, want, owners = [], [], {}
    for b in range(8):
        a = np.unique(np.append(rng.integers(1 << 30, 1 << 38, 150_000), np.arange(b % 3, 3000, 2) * 7919 + (1 << 30))).astype(np.uint64)
        second, ids = a % np.uint64(5), a % np.uint64(3) + np.uint64(b)
        rows.append((a, second, ids))
        for k, i, on in zip(a.tolist(), ids.tolist(), (second > 2).tolist(), strict=True):
            owners.setdefault(k, []).append((i, on))
    for a, _, ids in rows:
        if exact:
            want.append([k for k, i in zip(a.tolist(), ids.tolist(), strict=True) if i > min(owners[k])[0]])
        else:
            want.append([k for k in a.tolist() if len(owners[k]) > 1 and any(on for _, on in owners[k])])
    data = [substring_dedup.pack(substring_dedup._sorted(a), *((s, i) if exact else ((s > 2).astype(np.uint64),))) for a, s, i in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(data, pa.binary())], names=[substring_dedup.OWN + "batch", substring_dedup.OWN + "payload"])
    del owners
    tracemalloc.start()
    (out,) = substring_dedup._met(iter([batch]), exact)
    peak = tracemalloc.get_traced_memory()[1] / sum(len(a) for a, *_ in rows)
    tracemalloc.stop()
    got = {b: substring_dedup.unpack(x) for b, x in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert [np.cumsum(got[b][0]).tolist() if b in got else [] for b in range(8)] == want
    assert not exact or all((x[1] == np.cumsum(x[0]) % np.uint64(5)).all() for x in got.values())
    assert peak < 50, peak
