"""The registered queries: each operator with production parameters on its whole table, and DuckDB SQL where that can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, hard_negatives, hidden_markov, importance, langid, licenses, mixing, quality, secret_scan, simhash_dedup, token_counts, url_filters
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.ngram_weights(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.quality_rules(docs, weights).select("doc_id", "quality.*")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filters.url_verdicts(url_filters.page_captures(pages), url_filters.page_list(pages))
    return found.select("page_id", "host", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), "n_active", "categories", "blocked")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = token_counts.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), spec, 2048)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op11_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.hmm_scores(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_license_scan, op4_embedding_dedup, op5_token_counts, op6_secret_scan, op7_language_id, op8_source_mixing, op9_byte_bpe, op10_simhash_dedup, op11_hmm_scores, op12_importance_resampling, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_url_filters": url_filters.ORACLE_SQL, "op3_license_scan": licenses.oracle_sql(), "op6_secret_scan": secret_scan.oracle_sql(), "op8_source_mixing": mixing.oracle_sql(), "op13_hard_negatives": hard_negatives.ORACLE_SQL}
