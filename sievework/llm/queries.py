"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_extract, lm_score, mixing, ngram_join, oracle, quality_rules, suffix_dedup, warc, weak_label
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a derived record of each page's response."""
    records = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return records.select("record_id", "type", "refers_to", "target_uri", "refers_date", "source_digest", "block_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"), F.sha2(F.col("headers"), 256).alias("headers_sha256"))


def op3_weak_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label.classify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op2_warc, op3_weak_label, op4_quality_rules, op5_bpe, op6_html_extract, op7_embedding_dedup, op8_suffix_dedup, op9_lm_score, op10_mixing)
}
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": oracle.OP1, "op5_bpe": oracle.OP5, "op7_embedding_dedup": oracle.OP7, "op8_suffix_dedup": oracle.OP8}
