"""What the plans must look like, whatever the size of the input."""

import re

import pytest

from corpuslens.operators import chunks, css, files as fl, findings, rules, scores
from corpuslens.schemas import FILES


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "t")
    spark.createDataFrame([(f"r{i}", f"a{i}.py", 3, False, "x", True) for i in range(10)], FILES).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


def columns_read(df):
    return {name for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)) for name in re.findall(r"(\w+):", schema)}


def test_per_file_work_does_not_shuffle(stored):
    for df in (rules.match_rules(stored), rules.scan_findings(stored), rules.nested_loops(stored), rules.file_findings(stored), chunks.chunk_files(stored)):
        assert exchanges(df) == 0
        assert not any(node in plan(df) for node in ("ArrowEval", "BatchEval", "MapInPandas"))


def test_metadata_queries_do_not_read_content(stored):
    assert columns_read(fl.repo_facts(stored)) == {"repo_id", "path"}
    assert columns_read(fl.entry_points(stored)) == {"repo_id", "path"}
    assert columns_read(fl.repo_gate(stored)) == {"repo_id", "path", "size_bytes", "is_symlink"}


def test_shuffles_are_few_and_reduced(stored):
    assert exchanges(css.css_checks(stored)) == 1
    assert exchanges(fl.repo_gate(stored)) == 1
    deduped = findings.dedup_findings(rules.scan_findings(stored))
    assert exchanges(deduped) == 1 and plan(deduped).count("WindowGroupLimit") == 2
    assert plan(scores.penalties(deduped)).count("HashAggregate") == 2


def test_small_sides_are_counted_first(stored):
    from corpuslens.session import join_small

    few = stored.select("repo_id").limit(2)
    assert "BroadcastHashJoin" in plan(join_small(stored, few, "repo_id", "left_anti"))
    none = stored.where("repo_id = 'nobody'").select("repo_id", "size_bytes").withColumnRenamed("size_bytes", "cap")
    joined = join_small(stored, none, "repo_id", "left")
    assert "Join" not in plan(joined) and joined.where("cap is null").count() == 10
    assert join_small(stored, few, "repo_id", "left_anti").count() == 8


def test_large_sides_are_not_broadcast_by_hint(stored, monkeypatch):
    import corpuslens.session as session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    few = stored.select("repo_id").limit(3)
    logical = session.join_small(stored, few, "repo_id", "left_anti")._jdf.queryExecution().analyzed().toString()
    assert "hint" not in logical.lower()


def test_chunk_texts_are_not_joined_by_shuffle(stored):
    """Chunks are written once in order; numbering reads them back and joins one small row per group and task."""
    text = plan(chunks.build_chunk_index(stored))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 1
    assert not any(re.search(r"content#\d+", line) for line in text.splitlines() if "Exchange " in line)
