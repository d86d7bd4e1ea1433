"""The corpus pipeline: documents in, token ids out.

Each stage takes the documents that the one before has kept, as Parquet, and its
decisions take effect: rejected documents and later copies go, repeated passages
are cut, and the mix repeats or leaves out documents.
"""

from __future__ import annotations

import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe, common, mixing, ngram_join, quality_rules, suffix_dedup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_thread = threading.local()


def _scratch(spark: SparkSession) -> common.Scratch:
    """A stage's scratch tables. Those of the stage before it in this thread are no longer read: its result has been written."""
    if last := getattr(_thread, "last", None):
        last.close()
    _thread.last = common.Scratch(spark)
    return _thread.last


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; repeated rows are judged alike; no labels, only the base rule."""
    return quality_rules.keep_documents(docs, common.table(spark, sf_dir, "labels"), _scratch(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the smallest doc_id. Rows without words or doc_id stay, repeated rows once."""
    return ngram_join.keep_one(docs, _scratch(spark))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; documents of which no word is left go. Null and short texts stay as they are."""
    return suffix_dedup.remove_later_copies(docs, _scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Those without words are never taken; a null source is one of its own."""
    return mixing.mix_documents(docs, _scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row. Null texts are empty and have no ids."""
    _scratch(spark)
    return bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: Thresholds from binomial bounds, the exponential tilt and BPE are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read by the next.

    Every stage takes an empty table, and columns of any name beside those of
    documents, which all but the last hand on.
    """
    docs = common.table(spark, sf_dir, "documents")
    written = common.Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written.save(out, drop=[docs])
    return docs
