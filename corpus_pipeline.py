"""Corpus pipeline: language ID, exact and near deduplication, mixing and packing of the documents table.

All stages but the last keep the columns of their documents, whatever further columns there are and how they are named. Null ids, labels and sources
are values of their own; null texts go at the first stage. Repeated rows count each until exact deduplication leaves one. An empty table stays empty.
Stages with Python workers set the session's Arrow batches to BATCH rows at most, as their results are computed when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm.common import materialize
from quadlake.llm.exact_dedup import drop_exact_copies
from quadlake.llm.langid import drop_unidentified
from quadlake.llm.minhash import drop_near_copies
from quadlake.llm.mixing import mixed_documents
from quadlake.llm.packing import packed_documents


#: Documents that a Python worker is handed at a time: a partition's texts would else be there several times over, in its memory and in the executor's.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH:
        spark.conf.set(setting, BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose language is ambiguous, go. Learned from the labelled rows of docs; without any, all go."""
    small_batches(spark)
    return drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the most characters, then the smallest doc_id; null texts are equal to empty ones."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays; a text of fewer than five words is one shingle, one without words is no copy of any."""
    small_batches(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, twice at most; documents without words go. Null is a source of its own."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place there; a null text is empty. Long texts are cut, none is dropped."""
    small_batches(spark)
    return packed_documents(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Language ID, DartMinHash and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages applied to the documents of sf_dir, each stage's result being written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
