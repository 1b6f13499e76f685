"""The registered queries of the package: against SQL where SQL can tell, and their columns and rows elsewhere."""

import zlib

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, rows_of
from corpuslens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op9_balanced_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_phrase_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


def test_one_query_for_each_operator():
    names = [q for q in entry_point.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries() and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", ["op5_quality_classifier", "op10_language_id"])
def test_folds(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
