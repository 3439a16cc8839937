"""Documents to training sequences: quality rules, language, near-duplicates, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import read, stored
from corpusmill.llm.language import in_known_language
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.packing import TOKENIZER, pack_documents
from corpusmill.llm.quality import passing
from corpusmill.llm.similar import keep_one_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy; null and short texts go. All columns stay."""
    return passing(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from the given ones, a null ``lang`` being filled with it. Those without letters go, and those of
    which half the words are of no language; without any labels all do."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by a five-word Jaccard similarity of 0.8 or more; repeated rows count as copies.

    Links of the fingerprints of ``op5_simhash_near_duplicates`` come first, each checked exactly, then those that fingerprints can't see.
    """
    return keep_one_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a null source being a source."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; copies of a document are packed like documents of their own."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Language, tokens and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
