"""A training-corpus pipeline over `documents`: five stages of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet to the shared checkpoint folder, gives it, read again, to the next, and removes what that one
has read.

Defined cases: a document whose text is null or has no letters is rejected with its language; rows of
one doc_id and text are one document; a null doc_id is one of its own by its text; an empty table gives
an empty result; a user's own columns pass unchanged through all stages but the last.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.llm.common import checkpoint_dir, forget, settle
from tracequill.llm.decontaminate import drop_leaks
from tracequill.llm.language_id import predict, train
from tracequill.llm.ngram_join import near_components
from tracequill.llm.queries import vocabulary
from tracequill.llm.sentencepiece_bpe import encode_decode
from tracequill.llm.substring_dedup import dedup_substrings


#: The columns of documents that stages read or write; any others belong to the user and pass as they are.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keeping(stage):
    """The stage with the user's own columns out of the way of the operators' (`score`, `n_words`, ...): renamed before, and back after."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        return stage(spark, docs.withColumnsRenamed(own), sf_dir).withColumnsRenamed({v: k for k, v in own.items()})

    return run


@keeping
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts, with the language it gives them."""
    out = predict(docs, train(docs)).filter("not rejected")
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@keeping
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; ungrouped documents as they are.

    Rows of one doc_id and one text are one document and give one row. A null doc_id is grouped by a
    hash of the text over most ids in use: rows without an id are copies by their text alone, and of
    a group the row with an id stays.
    """
    text = F.coalesce("text", F.lit(""))
    stand_in = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn("__key", F.coalesce("doc_id", stand_in)).withColumn("__sha", F.when(F.col("text").isNull(), "").otherwise(F.sha2(text, 256)))
    groups = near_components(rows.select(F.col("__key").alias("doc_id"), "text"))
    copies = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("__key")).distinct()
    same = ["__key", "__sha"]
    kept = rows.join(copies, "__key", "left_anti")
    # Only ids and hashes are compared at first: most tables have no repeated rows, and whole rows then move once.
    if not rows.groupBy(same).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(same)
    return kept.select(*docs.columns)


@keeping
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that earlier ones hold; those with nothing left go."""
    out = dedup_substrings(docs, window=50)
    cut = F.col("n_removed") > 0
    out = out.filter(~(cut & (F.col("n_removed") == F.col("n_words"))))
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).withColumn("text", text).select(*docs.columns)


@keeping
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drop_leaks(docs, items).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document that stays."""
    settle(spark)
    out = encode_decode(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: The stages are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        forget(spark, f"{folder}/{k - 1}" if k else None)
    return docs
