"""Documents to token ids: bad text out, near copies out, secrets masked, sources mixed, then byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import bpe, mixing, quality, secret_scan, simhash_dedup
from locusframe.llm.common import remove, scratch, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; null and empty texts fail them. Repeated rows stay repeated. An empty table gives an empty result."""
    weights = quality.ngram_weights(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.quality_rules(docs, weights, name="__quality").where("__quality.kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest doc_id; rows without doc_id stay. An empty table gives an empty result."""
    return simhash_dedup.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mask; null texts stay null. An empty table gives an empty result."""
    return secret_scan.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the domains', languages' and sources' weights; one may come twice. An empty table gives an empty result."""
    return mixing.mix_documents(docs, percent=90, epochs=2)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document; a null text is an empty one. An empty table gives an empty result."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

ORACLE_SQL = None  # hashes of 64 bits, components and merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again for the next.

    A stage's own tables and its input are deleted when its output is written; the last stage reads the one before it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs, path = stored(stage(spark, docs, sf_dir))
            kept.add(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
