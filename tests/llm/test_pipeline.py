"""The pipeline, against its stages' brute-force versions."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tables):
    from .test_dedup import brute_components, brute_repeats

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    first = spark.createDataFrame(stages["language ID"](spark, docs, tables).collect(), docs.schema)
    groups = brute_components([(r.doc_id, r.text) for r in first.collect()])
    second = stages["n-gram Jaccard join"](spark, first, tables)
    assert {r.doc_id for r in second.collect()} == {i for i, (_, c) in groups.items() if c == i}
    second = spark.createDataFrame(second.collect(), docs.schema)
    repeats = brute_repeats([(r.doc_id, r.text) for r in second.collect()], 50)
    third = stages["substring dedup"](spark, second, tables)
    assert {r.doc_id: len((r.text or "").split()) for r in third.collect()} == {i: n - gone for i, (n, gone, _) in repeats.items() if not gone or gone < n}
    third = spark.createDataFrame(third.collect(), docs.schema)
    fourth = stages["benchmark decontamination"](spark, third, tables)
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().translate(low))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    items = [grams(words(r.text)) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in third.collect() if not any(i and 100 * len(grams(words(r.text)) & i) >= 75 * len(i) for i in items)}
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == clean and len(clean) < third.count()
    last = pipeline.run(spark, tables)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in fourth.collect()}
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeated_rows_and_null_ids(spark, tables):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (None, b), (None, b + " more"), (None, c), (None, c), (None, None), (3, ""), (3, "")]
    rows += [(4, " ".join(f"d{i}" for i in range(80))), (4, " ".join(f"e{i}" for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, (r.text or "")[:2]) for r in dict(pipeline.STAGES)["n-gram Jaccard join"](spark, docs, tables).collect()))
    assert got == [(0, ""), (0, "c0"), (1, "a0"), (2, "b0"), (3, ""), (4, "d0"), (4, "e0")]


def odd_documents(spark):
    """Nulls, blanks, repeated rows, a shared id, and columns named like those of the operators."""
    rng = random.Random(3)
    prose = lambda n, w="": " ".join(rng.choice(["river", "stone", "green", "quiet", "the", "of", "morning", "letter", "walks", "under"]) + w + str(rng.randint(0, 40)) for _ in range(n))
    a, b, c = prose(150), prose(160), prose(60)
    rows = [(1, a, "en"), (2, a, "en"), (2, a, "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, b, "en"), (7, b + " and one word more", "en"), (None, a, "en"), (None, c, None), (8, prose(40) + " " + " ".join(a.split()[:80]), "en"), (8, prose(50), "en")]
    full = [(i, t, lang, "web", len(t or ""), f"s{k}", k, f"r{k}") for k, (i, t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int, rejected string")


def test_stages_on_odd_rows(spark, tables):
    docs = odd_documents(spark)
    columns = docs.columns
    kept = pipeline.language(spark, docs, tables)
    assert kept.columns == columns and {r.text for r in kept.collect() if r.text and not any(map(str.isalpha, r.text))} == set()
    assert kept.filter("text IS NULL OR text = ''").count() == 0
    one = pipeline.near_duplicates(spark, docs, tables)
    rows = one.collect()
    assert one.columns == columns
    # Of the copies of a one row stays, with its own columns; of b the first; both texts of document 8; the null id by its text.
    assert sorted((r.doc_id or 0, r.score) for r in rows if r.text and len(r.text) > 10) == [(0, "s9"), (1, "s0"), (6, "s6"), (8, "s10"), (8, "s11")]
    assert sorted(r.doc_id for r in rows if not r.text) == [3, 4]
    cut = pipeline.repeated_passages(spark, docs, tables)
    by = {(r.doc_id, r.score): r for r in cut.collect()}
    assert cut.columns == columns and (2, "s1") not in by and by[8, "s10"].n_words == 10 and by[8, "s10"].n_chars == len(by[8, "s10"].text)
    assert len(by[8, "s10"].text.split()) == 40 and by[1, "s0"].text == docs.first().text
    left = pipeline.benchmark_leaks(spark, docs, tables)
    assert left.columns == columns and left.count() == docs.count()
    tokens = pipeline.tokens(spark, docs, tables).collect()
    assert len(tokens) == docs.count() and {r.n_tokens for r in tokens if r.doc_id in (3, 4)} == {1}


def test_stages_on_an_empty_table(spark, tables):
    docs = odd_documents(spark).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
