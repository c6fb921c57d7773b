"""Queries of the numbered operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, embeddings, isolation, licenses, lm, merkle, minhash, mixing, prefixes, rules, spelling, toxicity, warc
from tarn.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MIX_PERCENT, MIX_EPOCHS = 60, 4


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ["doc_id"])
    return bpe.decode(encoded, RANKS, digests=True)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), mixing.document_levels(), mixing.WEIGHTS, MIX_PERCENT, MIX_EPOCHS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.token_counts(read(spark, sf_dir, "documents"), PIECES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_byte_bpe,
        op3_quality_classifier,
        op4_lm_scoring,
        op5_toxicity,
        op6_source_mixing,
        op7_warc,
        op8_license_scan,
        op9_embedding_near_dedup,
        op10_quality_rules,
        op11_merkle_manifest,
        op12_token_counts,
        op13_spelling_variants,
    )
}
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.SQL,
    "op9_embedding_near_dedup": embeddings.SQL,
    "op6_source_mixing": mixing.oracle(mixing.WEIGHTS, MIX_PERCENT, MIX_EPOCHS),
    "op7_warc": warc.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_spelling_variants": spelling.SQL,
}
