"""From documents to packed training sequences: quality, near duplicates, mixing, packing.

Each stage gets what the one before has kept, as a table of its own, and decides on all of it. All
but the last return the columns of ``documents``, whatever their names.

A null text is an empty one and a null doc_id is allowed everywhere; repeated rows are documents of their own
until ``near_duplicates`` keeps one of each class; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import saved, table
from runlens.llm.minhash import drop_near_duplicates
from runlens.llm.mixing import mix
from runlens.llm.packing import pack_documents
from runlens.llm.quality import THRESHOLD, fit_quality, probability
from runlens.llm.queries import MIX_TARGETS, VOCABULARY, topic_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good, by the threshold of its ``predicted``; labels outside the held-out
    fold teach it. Empty texts have a score like any other."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(probability(F.col("text"), model) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates; texts without words are one class."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that give the target shares of tokens; nulls are a category of their own."""
    return mix(docs, MIX_TARGETS, topic_of(F.col("text"))).where("selected = 1").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 2048 tokens; an empty text is one end token."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: A trained classifier has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read back before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
