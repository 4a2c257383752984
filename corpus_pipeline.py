"""Corpus pipeline over ``documents``: language identification, exact
deduplication, near-duplicate removal, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result
to the shared folder as Parquet and gives what it reads back to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reco.llm import bpe, exact_dedup, langid, mixing, simhash
from reco.llm.common import stored
from reco.llm.queries import RANKS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language stay; null and letterless texts go."""
    return langid.accepted(docs, langid.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal texts the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_rows(docs, mixing.word_count(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round-trip digests of every document of the mix."""
    return bpe.digest_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("byte_bpe", encode)]

#: SQL can't express the fitted classifiers, the SimHash components, the
#: length fitting or the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
