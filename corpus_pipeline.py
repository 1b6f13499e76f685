"""A training-data pipeline over ``documents``: each stage works on all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of ``docs`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import save, table
from corpuslens.llm.jaccard_join import keep_first_of_groups
from corpuslens.llm.language_id import keep_identified
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.quality_classifier import keep_good


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Dictionaries come from the labelled rows that may be learned from."""
    return keep_identified(docs, docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; learned from ``labels`` of documents that may be learned from."""
    return keep_good(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (five-word shingles, a similarity of 0.8 or more), the one with the
    smallest id."""
    return keep_first_of_groups(docs, words=5, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice, so that sources come near even shares."""
    return mix_sources(docs, facts=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("packing", packing),
]

#: Neither compression nor learned models can be told in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
