"""Language, toxicity, leaks, licences and fingerprints."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from tracequill.llm import licenses, queries, toxicity
from tracequill.llm.decontaminate import drop_leaks, find_leaks
from tracequill.llm.fingerprints import as_string, compare_edited, hashes, with_fingerprint
from tracequill.llm.language_id import Classifier, predict, train


def test_op5_held_out(spark, tables):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5_equals_an_own_loop_over_dictionaries(spark, tables):
    """The smallest sum of compressed pieces, measured with coders made here."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    learned = train(docs.filter(queries.bucket(5) != 0))
    got = {r.doc_id: r for r in queries.op5_language_id(spark, tables).collect()}
    coders = {}
    for lang, data in learned.samples.items():
        like = zstandard.ZstdCompressionParameters.from_level(6, source_size=4000, dict_size=len(data), write_content_size=0)
        how = zstandard.ZstdCompressionParameters.from_level(6, source_size=4000, dict_size=len(data), write_content_size=0, window_log=max(17, like.window_log))
        coders[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
    sure = 0
    for r in docs.collect():
        text = r.text or ""
        if not any(map(str.isalpha, text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        data = b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()))
        sizes = sorted((sum(len(c.compress(data[i : i + 65536])) for i in range(0, max(1, len(data)), 65536)), lang) for lang, c in coders.items())
        if sizes[1][0] - sizes[0][0] >= 3:
            sure += 1
            assert got[r.doc_id].lang_pred == sizes[0][1]
    assert sure > 150


def test_language_of_odd_rows(spark, odd_docs):
    rows = predict(odd_docs, train(odd_docs.filter("doc_id is not null"))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    assert {r.lang_pred for r in predict(odd_docs, Classifier({})).collect()} == {"und"}
    assert predict(odd_docs.limit(0), Classifier({})).count() == 0


def test_language_of_long_texts():
    """The most of a text decides, wherever in it and however small the dictionaries are."""
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000)] for _ in range(2)]
    prose = lambda k, n: " ".join(words[k][i] for i in rng.integers(0, 3000, n // 7))
    c = Classifier({"one": prose(0, 110_000).encode(), "two": prose(1, 110_000).encode()})
    assert c.classify(prose(0, 100_000) + " " + prose(1, 1_000_000))[0] == "two"
    assert c.classify(prose(1, 100_000) + " " + prose(0, 1_000_000))[0] == "one"
    words = [w[:150] for w in words]
    prose = lambda k, n: " ".join(words[k][i] for i in rng.integers(0, 150, n // 7))
    c = Classifier({"one": " ".join(words[0]).encode(), "two": " ".join(words[1]).encode()})
    junk = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 20_000))
    late = [c.classify(f"{junk} {prose(k, 10_000)}") for k in (0, 1)]
    assert [x[::2] for x in late] == [("one", False), ("two", False)]


def test_op6_learns_and_covers_all(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.7 else 0) for r in rows)
    # Held-out rows: none of them was learned from.
    known = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in known)
    bad, good = ([r.score for r in known if labels[r.doc_id] == k] for k in (1, 0))
    assert len(bad) > 5 and np.mean([b > g for b in bad for g in good]) > 0.8


def test_toxicity_without_labels():
    m = toxicity.fit([], np.zeros(0), [])
    assert m.scores(pa.array(["x", None, ""])).tolist() == [0.0, 0.0, 0.0]
    ids, off = toxicity.buckets(pa.array(["good words", "vile words", None, ""] * 20))
    m = toxicity.fit([ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], np.array([0, 1, 0, 0] * 20, float), ["en"] * 80)
    s = m.scores(pa.array(["vile " * 5000, "good", None]))
    assert s[0] > s[1] and np.isfinite(s).all()


def _toxic_rows(spark, vile: str):
    """60 texts of label 0 and 40 of label 1."""
    rows = [(i, f"good words number {i % 7}" if i % 5 > 1 else f"{vile}number {i % 7}", "en") for i in range(100)]
    labels = [(i, int(i % 5 < 2)) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Long texts are learned from like others, and rows count whatever their number."""
    docs, labels = _toxic_rows(spark, "vile " * 21_000)
    m = toxicity.train(docs, labels)
    assert m.flat is None
    vile, good = m.scores(pa.array(["vile number", "good words"]))
    assert vile > good
    docs, labels = _toxic_rows(spark, "vile ")
    one = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 20)
    monkeypatch.setattr(toxicity, "SAMPLE", 10, raising=False)
    several = toxicity.train(docs, labels)
    assert several.active.tolist() == one.active.tolist()
    assert np.array_equal(several.lang_table, one.lang_table)
    vile, good = several.scores(pa.array(["vile number", "good words"]))
    assert vile > good


def test_toxicity_scores_do_not_depend_on_neighbours():
    ids, off = toxicity.buckets(pa.array(["good words", "vile words", None, ""] * 20))
    m = toxicity.fit([ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], np.array([0, 1, 0, 0] * 20, float), ["en"] * 80)
    texts = ["good", "vile words", "", "vile", None, "words good vile"]
    assert m.scores(pa.array(texts)).tolist() == [m.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert m.scores(pa.array(["vile good " * 100_000, "good"])).tolist() == [m.scores(pa.array([t]))[0] for t in ("vile good " * 100, "good")]


def test_op8_equals_brute_force(spark, tables):
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    docs = {r.doc_id: grams(words(r.text)) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    items = {r.item_id: grams(words(r.text)) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    expected = {(d, i, len(x & y)) for d, x in docs.items() for i, y in items.items() if y and 100 * len(x & y) >= 75 * len(y)}
    got = {(r.doc_id, r.item_id, r.n_shared) for r in queries.op8_decontamination(spark, tables).collect()}
    assert got == expected and expected


def test_leaks_of_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "word3 word4 Word5, word6 word7 word8 word9"), (2, "one two"), (3, None), (4, ""), (5, "nothing like it anywhere in there")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in find_leaks(odd_docs, items).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (6, 2), (7, 1)]
    assert sorted(r.n_words for r in drop_leaks(odd_docs, items).collect()) == [3, 4, 5, 8, 9, 10, 11, 12]
    assert find_leaks(odd_docs.limit(0), items).count() == find_leaks(odd_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op2_license_scan"}))
def test_query_equals_sql(spark, tables, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    got = queries.QUERIES[name](spark, tables)
    want = c.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_op2_equals_sql(spark, tables):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    got = queries.op2_license_scan(spark, tables)
    assert got.columns == ["doc_id", "license", "dice", "n_units"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(c.execute(queries.ORACLE_SQL["op2_license_scan"]).fetchall())


def test_every_template_is_found(spark, odd_docs):
    rows = [(i, f"Some prose.\n{t.upper()}\nMore.") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, 1.0) for i, n in enumerate(licenses.TEMPLATES)}
    assert licenses.scan_licenses(odd_docs).count() == licenses.scan_licenses(odd_docs.limit(0)).count() == 0


def test_wrapped_and_inline_notices(spark):
    """Notices wrapped in longer texts, or in lines with other words, and what is found once only."""
    import textwrap

    rest = " ".join(f"word{i} of the" for i in range(300))
    body = licenses.TEMPLATES
    heads = {n: b for n, b in body.items() if n.endswith("-header")}
    rows = {n: f"{rest}\n{textwrap.fill(b, 78)}\n{rest}" for n, b in body.items()}
    rows["inline"] = "Copyright 2021 Foo Inc. Released under the MIT License. All rights reserved."
    rows["two"] = f"{rest} {textwrap.fill(heads['mit-header'], 60)} {rest} {body['mpl-2.0']} {rest}"
    rows["edited"] = rest + "\n" + textwrap.fill(heads["gpl-3.0-header"].replace("General", "Quite General").replace("useful", "of use"), 50)
    rows["line and run"] = f"{body['mit']}\n{rest} {body['gpl-3.0']} {rest}"
    rows["line"] = f"{rest}\n{body['mit']}\n{rest}"
    rows["near"] = f"{rest} released under the old rules, the mit people say; a license is general public version {rest}"
    found = licenses.scan_licenses(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()
    got = {r.doc_id: (r.license, r.dice, r.n_units) for r in found}
    edited = got.pop("edited")
    assert edited[0] == "gpl-3.0-header" and 0.75 <= edited[1] < 1 and edited[2] == 1
    assert {n: got.pop(n) for n in heads} == {n: (n, 1.0, 1) for n in heads}
    assert {n: got.pop(n)[:2] for n in body if n not in heads} == {n: (n, 1.0) for n in body if n not in heads}
    assert got == {"inline": ("mit", 1.0, 1), "two": ("mpl-2.0", 1.0, 2), "line and run": ("mit", 1.0, 2), "line": ("mit", 1.0, 1)}


def xx(value: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(value, seed & (1 << 64) - 1)


def murmur(value: int) -> int:
    """The engine's 32-bit hash of a 64-bit number, seed 42."""
    m = (1 << 32) - 1
    h = 42
    for k in (value & m, value >> 32 & m):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) * 0x1B873593 & m
        h ^= k
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def brute_winnow(text, gram=4, window=8):
    """(hash, position) of every window's smallest gram hash, the rightmost of equal ones."""
    words = [xx(w) for w in text.encode().split()]
    pack = lambda x: x.to_bytes(8, "little")
    two = lambda a, b: xx(pack(b), xx(pack(a)))
    if len(words) >= gram:
        pairs = [two(a, b) for a, b in zip(words, words[1:])]
        grams = [two(a, b) for a, b in zip(pairs, pairs[2:])]
    elif words:
        whole = 42
        for x in words:
            whole = xx(pack(x), whole)
        grams = [whole]
    else:
        grams = []
    entries = [(murmur(g), -i) for i, g in enumerate(grams)]
    kept = [min(entries[i : i + window]) for i in range(max(1, len(entries) - window + 1))] if entries else []
    return [(h, -i) for h, i in dict.fromkeys(kept)]


def test_op10_equals_brute_winnowing(spark, tables):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, tables).collect()}
    shown = lambda f: " ".join(f"{h}:{i}" for h, i in f)
    alike = lambda f, g: 1.0 if not f and not g else len({h for h, _ in f} & {h for h, _ in g}) / len({h for h, _ in f} | {h for h, _ in g})
    for k, (i, t) in enumerate(docs):
        cut, after = len(t) // 3, docs[(k + 1) % len(docs)][1]
        own, edited, following = brute_winnow(t), brute_winnow(t[: len(t) - cut] + after[:cut]), brute_winnow(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(edited))
        assert abs(got[i].near_edited - alike(own, edited)) < 1e-9 and abs(got[i].near_next - alike(own, following)) < 1e-9


def test_fingerprint_positions_and_guarantee(spark):
    shared = [f"s{i}" for i in range(11)]
    a, b = " ".join([f"a{i}" for i in range(50)] + shared), " ".join(shared + [f"b{i}" for i in range(70)])
    df = with_fingerprint(spark.createDataFrame([(1, a), (2, b), (3, "x " * 40), (4, "just three words"), (5, ""), (6, None)], "i int, text string"), "text", "fp")
    rows = {r.i: r for r in df.select("i", as_string("fp").alias("s"), hashes("fp").alias("h")).collect()}
    assert set(rows[1].h) & set(rows[2].h)
    for i, text in ((1, a), (2, b)):
        n, window = len(text.split()) - 3, 8
        at = [int(x.split(":")[1]) for x in rows[i].s.split()]
        assert at == sorted(at) and at[0] < window and at[-1] >= n - window and max(np.diff(at)) <= window
    # Equal grams: the rightmost of every window.
    assert [int(x.split(":")[1]) for x in rows[3].s.split()] == list(range(7, 37)) and len(rows[3].h) == 1
    assert len(rows[4].h) == 1 and rows[5].s == rows[6].s == ""


def test_op10_edits(spark, tables, odd_docs):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, tables).collect()}
    for k, (i, t) in enumerate(docs):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + docs[(k + 1) % len(docs)][1][:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.35 and np.mean([r.near_next for r in long]) < 0.05
    rows = compare_edited(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert compare_edited(odd_docs.limit(0)).count() == 0
