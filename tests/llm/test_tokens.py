"""SentencePiece coding, token-id files and edit-aware counts, against the libraries."""

import random
import zlib

import numpy as np
import pytest

from tracequill.llm import queries
from tracequill.llm.sentencepiece_bpe import BpeModel, encode_decode
from tracequill.llm.token_counts import Counter, CountTree, count_tokens
from tracequill.llm.token_ids import Shard, compress, encode_texts, expand, read_ids, write_ids

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("tiktoken")
PIECES = [*"aab  \n\t▁éßñ世界😀ﬁ\x00<>0x/sthe'12.", "the ", "ing", "    ", "aaaa", "́", "<0x0A>", "</s>", "�", "İ", "'s", "\n\n", "<|endoftext|>", "tes", "==="]


def texts(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_sentencepiece_equals_library():
    path = queries.vocabulary("piece_bpe_32k.model")
    own, library = BpeModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(1, 400):
        ids = library.encode(t) + [2]
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)


def test_encoding_is_bounded_in_memory(monkeypatch):
    """Many distinct segments are merged some at a time and dropped from the cache; the ids stay the library's."""
    from tracequill.llm import sentencepiece_bpe as bpe

    path = queries.vocabulary("piece_bpe_32k.model")
    own, library = BpeModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(bpe, "MERGED", 1 << 10, raising=False)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1 << 16, raising=False)
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda s, off: merged.append(len(s)) or merge(s, off))
    rng = random.Random(3)
    docs = [" ".join("".join(rng.choices("abcdeé中", k=rng.randint(1, 9))) for _ in range(500)) for _ in range(20)]
    assert [own.encode(t) for t in docs] == [library.encode(t) + [own.end] for t in docs]
    assert max(merged) <= 2 << 10 and len(own.cache) < 1000
    own.drop()
    own.encode_all([t.encode() for t in docs])
    assert max(merged) <= 2 << 10


def test_op4_on_documents_and_odd_rows(spark, tables, odd_docs):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    for r in queries.op4_sentencepiece(spark, tables).collect():
        ids = library.encode(docs[r.doc_id]) + [2]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    out = encode_decode(odd_docs, queries.vocabulary("piece_bpe_32k.model"))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.ids == library.encode(r.text or "") + [2] and r.decoded == (r.text or "") for r in rows)
    assert encode_decode(odd_docs.limit(0), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_ids_equal_library():
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    some = [*texts(2, 300), "Ünïcödé's ÀÇ’t x¼y ﬁ Σς ΑΣ it'sit''S 'LL ŉ ǅ ſ Ĳ", "é x́"]
    got = encode_texts([t.encode() for t in some], path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 60)
    ids = rng.integers(0, 4, int(lengths.sum()))
    ids[np.cumsum(lengths) - 1] = 2
    shard = Shard(Shard.write(list(range(59)) + [None], ids, lengths))
    assert len(shard.rules) and shard.offsets[-1] < len(ids)
    found, per = shard.all()
    assert (found == ids).all() and (per == lengths).all()
    ends = np.cumsum(lengths)
    for k in (0, 17, 59):
        assert (shard.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all()
    symbols, per, rules = compress(ids, lengths)
    assert per.sum() == len(symbols) and (expand(symbols, rules, int(ids.max()) + 1) == ids).all()


def test_one_document_opens_its_own_blocks():
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 800, 1000)
    ids = rng.integers(3, 49_000, int(lengths.sum()))
    shard = Shard(Shard.write(list(range(1000)), ids, lengths))
    assert len(shard.places) - 1 > 4
    ends = np.cumsum(lengths)
    for k in (0, 400, 999):
        shard.opened = 0
        assert (shard.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all() and shard.opened <= 2


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    lengths = np.full(200, 500)
    ids = np.minimum(rng.zipf(1.3, 100_000), 3000)
    symbols, per, rules = compress(ids, lengths)
    last = np.cumsum(per)[:-1] - 1
    inner = np.setdiff1d(np.arange(len(symbols) - 1), last)
    _, count = np.unique((symbols[:-1] << 31 | symbols[1:])[inner], return_counts=True)
    assert count.max() < 16 * 2  # runs of one symbol count their overlaps
    used = np.bincount(np.concatenate([symbols, rules.ravel()]))
    assert (used[int(ids.max()) + 1 :] > 0).all()


def test_op9_files(spark, tables, odd_docs):
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_ids(spark, tables).collect()}
    start = 0
    for i, t in docs:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = read_ids(spark, write_ids(odd_docs, path, 2)).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert read_ids(spark, write_ids(odd_docs.limit(0), path, 2)).count() == 0


def test_counts_under_edits():
    own = Counter(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pretoken_pattern())
    rng = random.Random(3)
    for t in texts(4, 150, 300):
        tree = CountTree(t, own)
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b = min(len(tree.text), a + rng.choice([0, 1, 3, 50]))
            put = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 4, 60])))
            new = tree.text[:a] + put + tree.text[b:]
            assert tree.edit(a, b, put) == len(own.coder.encode_ordinary(new)) and tree.text == new


def test_op7_rows(spark, tables, odd_docs):
    own = Counter(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pretoken_pattern())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    for r in queries.op7_token_counts(spark, tables).collect():
        t = docs[r.doc_id]
        edited = t[: len(t) // 2] + "[removed]" + t[min(len(t), len(t) // 2 + 40) :]
        assert (r.n_tokens, r.n_tokens_edited) == (len(own.coder.encode_ordinary(t)), len(own.coder.encode_ordinary(edited)))
        assert r.n_reencoded < 40
    rows = count_tokens(odd_docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pretoken_pattern()).collect()
    assert len(rows) == odd_docs.count() and {r.n_tokens for r in rows if not r.text} == {0}


def test_no_frequent_pair_is_left():
    import numpy as np

    from tracequill.llm import token_ids

    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 100_000, 100_000)] + [np.append(rng.integers(0, 100_000, 90), range(7, 17)) for _ in range(40)])
    symbols, per, rules = token_ids.compress(ids, np.array([len(ids)]))
    assert per.tolist() == [len(symbols)] and (token_ids.expand(symbols, rules, int(ids.max()) + 1) == ids).all()
    _, count = np.unique((symbols[:-1] << 31) | symbols[1:], return_counts=True)
    assert count.max() < token_ids.FREQUENT


def test_later_rounds_leave_rare_pairs_alone(monkeypatch):
    from tracequill.llm import token_ids

    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 100_000, 100_000)] + [np.append(rng.integers(0, 100_000, 90), range(7, 17)) for _ in range(40)])
    count, looked = np.bincount, []
    monkeypatch.setattr(np, "bincount", lambda x, **how: (how.get("minlength") == token_ids.BUCKETS and looked.append(len(x)), count(x, **how))[1])
    symbols, _, rules = token_ids.compress(ids, np.array([len(ids)]))
    assert (token_ids.expand(symbols, rules, int(ids.max()) + 1) == ids).all()
    assert len(looked) > 2 and sum(looked[1:]) < len(ids) / 2


def test_pieces_of_words_equal_library():
    """Every plain character and its neighbours in Unicode, and runs of apostrophes, letters, digits and signs."""
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    chars = [chr(c) for c in [*range(1, 0x250), 0x300, 0x3A3, 0x2028, 0x3000, 0x4E16, 0xFB01, 0x1F600]]
    some = [x for c in chars for x in (c, f"a{c}B", f"{c}'S{c}'ll{c}")]
    some += ["".join(rng.choices("''''stmdrevlSLRE0.,é", k=rng.randint(0, 30))) for _ in range(1500)]
    some += ["".join(rng.choices(chars, k=60)) for _ in range(300)] + ["'", "'l", "'r", "it'", "so", "<|endoftext|>x", None]
    got = encode_texts([t if t is None else t.encode() for t in some], path)
    want = library.encode_batch([t or "" for t in some], add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in want]


def test_words_are_encoded_in_bulk():
    """No Python call for a word: far fewer calls than distinct words."""
    import sys

    path = queries.vocabulary("word_bpe_49k.json")
    rng = random.Random(8)
    words = list({"".join(rng.choices("abcdefghé", k=9)) + rng.choice([".", "", "'s"]) for _ in range(20_000)})
    texts = [" ".join(words[i : i + 500]).encode() for i in range(0, len(words), 500)]
    encode_texts([b"warm"], path)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = encode_texts(texts, path)
    finally:
        sys.setprofile(None)
    library = tokenizers.Tokenizer.from_file(path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert len(calls) < len(words) / 10
