"""One query per operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, oracles, toxicity
from .decontaminate import find_leaks
from .filter_audit import audit_filters
from .fingerprints import compare_edited
from .language_id import predict, train
from .ngram_join import near_components
from .sentencepiece_bpe import encode_decode
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .token_ids import read_ids, write_ids
from .warc import archive_pages
from .whitening import whiten_vectors

try:
    import public_tokenizers
except ImportError:  # the vocabulary files are no part of this repository
    public_tokenizers = None


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; TOKENIZERS_DIR or /opt/tokenizers where the package is absent."""
    if public_tokenizers is not None:
        return public_tokenizers.path(name)
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs, window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, vocabulary("piece_bpe_32k.model"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def bucket(modulus: int):
    """crc32 of the id as text, modulo `modulus`: which rows a model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    classifier = train(docs.filter(bucket(5) != 0))
    out = predict(docs.select("doc_id", "text"), classifier)
    return out.select("doc_id", (bucket(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(bucket(3) != 1))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket(3) == 1).alias("held_out"), "score", "predicted")


#: The pre-token pattern of the byte-level vocabularies, as their package publishes it.
def pretoken_pattern() -> str:
    if public_tokenizers is not None:
        return public_tokenizers.PATTERN
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), pretoken_pattern())
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, percent=75)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(spark, write_ids(docs, vocabulary("word_bpe_49k.json"), end=2))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_token_ids": op9_token_ids,
    "op10_fingerprints": op10_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op2_license_scan": licenses.oracle(),
    "op3_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op12_warc": oracles.WARC,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
