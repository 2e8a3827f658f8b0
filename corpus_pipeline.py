"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes nulls in any column, repeated rows and null ids, and an empty table, whose result is empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wxlake.llm import common, langid, neardup, packing, pii, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters (null and empty texts too) or a likely language go.
    Where no document has a language, all with a letter stay."""
    return langid.known_language(docs, langid.fit(docs.where(~common.held_out()), limits=True))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Null and empty texts stay unless the bias alone says toxic; without labels all stay."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.not_toxic(docs, toxicity.fit(docs.where(~common.held_out()), labels.where(~common.held_out())))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, chosen by row; texts without words stay."""
    return neardup.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked, and their lengths brought up to date. Null texts stay null."""
    return pii.mask(docs, pii.fit(pii.candidates(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences. An empty text is one piece, the end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("toxicity", clean), ("near_dedup", unique), ("pii", private), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
