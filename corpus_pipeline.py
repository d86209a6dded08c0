"""From documents to token ids in four stages: language ID, near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landmarq.llm import bpe, langid, mixing, simhash
from landmarq.llm._common import materialise, table
from landmarq.llm.queries import word_vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused evidence names a language."""
    return langid.accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that five-word shingles liken by 0.8 or more: near fingerprints first, then the rest, all verified."""
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy of each document, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, word_vocabulary(), with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: No SQL has the fitted language model, the fingerprints' cells or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
