"""One registered query for each operator of this package, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import table
from corpuslens.llm.fingerprints import fingerprint_documents
from corpuslens.llm.html_text import extract_pages
from corpuslens.llm.jaccard_join import jaccard_components
from corpuslens.llm.language_id import identify_languages
from corpuslens.llm.license_scan import scan_licenses
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.oracles import ORACLES
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.phrases import collocations
from corpuslens.llm.prefix_trie import prefix_trie
from corpuslens.llm.quality_classifier import classify_quality
from corpuslens.llm.quality_rules import quality_rules
from corpuslens.llm.sharding import shard_documents
from corpuslens.llm.token_files import token_files_roundtrip


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_roundtrip(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "__mix.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_best_fit_packing, op3_ngram_jaccard_join, op4_token_files, op5_quality_classifier,
    op6_document_fingerprints, op7_source_mixture, op8_license_scan, op9_balanced_shards, op10_language_id,
    op11_phrase_collocations, op12_html_extraction, op13_prefix_trie,
)}
