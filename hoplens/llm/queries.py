"""Registered queries of the training-data operators: each applies one
operator, with its production parameters, to its whole table."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import hoplens.llm as package
from hoplens.llm import (conversations, embedding_dedup, exact_dedup, language, mixing, packing, pii,
                         probminhash, quality, repeats, toxicity, warc, whitening)

# Functions of this subpackage travel to the executors with their code, so
# that the executors need no installed copy of it.
for _m in pkgutil.iter_modules(package.__path__):
    if _m.name not in ("queries", "oracle"):
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{package.__name__}.{_m.name}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.cube_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicate_groups(table(spark, sf_dir, "documents")).drop("_k", "_dup")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_pack_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("_k", "_dup")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_cube, op2_embedding_dedup, op3_quality_fm, op4_probminhash, op5_language_id,
    op6_pack_variable, op7_exact_dedup, op8_warc, op9_prefix_free_repeats, op10_pii_crf,
    op11_toxicity_zstd, op12_conversation_repair, op13_whitening)}
