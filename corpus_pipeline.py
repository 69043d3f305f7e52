"""Corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage works on what the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitrace.llm.language_id import keep_identified
from orbitrace.llm.ngram_join import keep_one_per_class
from orbitrace.llm.packing import pack_documents
from orbitrace.llm.pii import redact_documents
from orbitrace.llm.quality_rules import keep_quality
from orbitrace.session import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule of the current policy go."""
    return keep_quality(docs.select(*COLUMNS), "v1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told, mixed ones and mislabelled ones go; prototypes are learned from the
    labels of this stage's input."""
    return keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays."""
    return keep_one_per_class(docs.select(*COLUMNS), threshold=0.8, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in the training sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted when the next one is written.

    Nulls in any column, empty and repeated rows go through; extra columns are left out by the first stage; an empty
    table gives an empty result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language prototypes, similarity classes and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
