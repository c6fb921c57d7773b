"""A corpus pipeline of five stages over ``documents``: what is kept, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's documents. All but the last return the columns of documents.

What holds for every stage: null texts are empty texts, nulls in other columns are values like any
other, texts of any length count whole, rows that repeat one another meet the same fate, columns
besides those of documents pass through the first four stages whatever their names, and no documents
give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, minhash, mixing, rules, toxicity
from tarn.llm.common import read, shared_dir, small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The mixture takes so much of the tokens that reach it, each document once at most.
MIX_PERCENT = 80


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject.

    Null and empty texts have no words that speak against them and stay. Without labels of both
    classes nothing is rejected. A score at the threshold itself is rejected.
    """
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are judged by the statistics of a text without words. Without labels of
    both classes all have one score above the threshold and stay, as does a score at the threshold.
    """
    return rules.keep_good(docs, read(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8.

    The smallest id of a group stays, with all rows that repeat it. Null and empty texts and rows
    with a null id are like nothing and stay.
    """
    small_batches(spark)
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of domains, languages and sources by their target weights.

    Null languages and sources are nodes of their own. Null and empty texts have no tokens and
    cost their leaf nothing. The seeded order is a digest of the id, a null one being empty there,
    so only rows that repeat an id tie, and they stand or fall together.
    """
    return mixing.mixed(docs, mixing.document_levels(), mixing.WEIGHTS, MIX_PERCENT, max_epochs=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of the texts, and the digests of the ids and of what they decode to.

    A null or empty text has no ids and the digests of nothing; a null id stays null; columns
    besides doc_id and text are left out.
    """
    small_batches(spark)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    return bpe.decode(ids, RANKS, digests=True, keep_ids=True)


STAGES = [
    ("toxicity", ordinary),
    ("quality classifier", good),
    ("MinHash near-dedup", unique),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]
#: Scores of learned models are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    The folders stay there until the shared folder is cleaned. A lost executor costs the tasks it
    ran of the stage at hand, as earlier stages are written.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
