"""From raw documents to packed training sequences.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir), where
``docs`` is what its predecessor kept, and returns a DataFrame.  All but the
last return the columns of ``documents``.  ``run`` applies them, and writes each
stage's result to the shared folder and reads it again.

1. quality: documents that the classifier rejects go (learned from ``labels``).
2. exact dedup: of equal texts the one with the largest doc_id stays.
3. near duplicates: of each component of 5-word shingle sets with Jaccard
   similarity of 0.75 or more the least doc_id stays.
4. mixing: documents are repeated by Poisson draws to square-root source
   weights, and shuffled.
5. packing: ids in sequences of at most 1024 tokens.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qpanel.llm import exact_dedup, jaccard_join, mixing, packing, quality
from qpanel.llm.common import documents, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, docs.columns, only_good=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("packing", pack),
]

# The classifier, the shingle components and the tokenizer are beyond SQL; the
# tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
