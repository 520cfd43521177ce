"""The corpus pipeline: quality filter, exact dedup, near dedup, source mix, packing.

Each stage takes the documents that the one before kept and returns documents
with the same columns; the last returns the packed pieces. ``run`` writes each
stage to the shared folder and reads it back, so a lost executor costs a stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hoplens.llm import exact_dedup, mixing, packing, probminhash, quality
from hoplens.llm.common import stage
from hoplens.llm.queries import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return probminhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: The classifier and the sampler are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
