"""The inverted-file index: exact when all lists are probed, recall with the default probes, odd vectors, large lists."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import vector_index as vi
from corpuslens.operators.retrieval import retrieve_chunks

CHUNK = "repo_id string, chunk_id bigint, embedding array<float>"
QUESTION = "question_id string, repo_id string, embedding array<float>"


def key(rows):
    return sorted((r.question_id, r.repo_id, r.chunk_id, r.rank, round(r.distance, 6)) for r in rows)


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """The embeddings as the chunks of one large and some small repositories, and other vectors near them as questions."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    repo = F.when(F.col("vec_id") < 1500, "big").otherwise(F.concat(F.lit("r"), (F.col("vec_id") % 7).cast("string")))
    chunks = rows.select(repo.alias("repo_id"), F.col("vec_id").alias("chunk_id"), "embedding", F.lit("x").alias("content"), F.lit("clash").alias("list"))
    near = F.transform("embedding", lambda x, i: (x + 0.02 * F.sin(i + F.col("vec_id"))).cast("float"))
    questions = rows.select(F.concat(F.lit("q"), "vec_id").alias("question_id"), repo.alias("repo_id"), near.alias("embedding"))
    base = str(tmp_path_factory.mktemp("vectors"))
    chunks.write.parquet(f"{base}/chunks")
    questions.write.parquet(f"{base}/questions")
    return spark.read.parquet(f"{base}/chunks"), spark.read.parquet(f"{base}/questions")


def test_all_probes_are_exact_and_few_are_close(spark, given, tmp_path):
    chunks, questions = given
    index = vi.build_vector_index(chunks, str(tmp_path / "index"))
    assert 30 <= len(index.centroids) <= 60
    assert index.chunks(spark).count() == chunks.count() and "content" in index.chunks(spark).columns
    exact = retrieve_chunks(questions, chunks).cache()
    assert key(vi.search_vectors(questions, index, probes=None).collect()) == key(exact.collect())
    shares = {}
    for probes in (1, vi.PROBES):
        found = vi.search_vectors(questions, index, probes=probes)
        shares[probes] = vi.recall(found, exact)
        assert found.groupBy("question_id").count().where("count > 6").isEmpty()
    assert shares[vi.PROBES] >= 0.9 and shares[1] < shares[vi.PROBES]
    again = vi.VectorIndex.load(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centroids, index.centroids)
    assert key(vi.search_vectors(questions.limit(50), again).collect()) == key(vi.search_vectors(questions.limit(50), index).collect())


def test_a_search_reads_the_folders_it_probes(spark, given, tmp_path):
    chunks, questions = given
    index = vi.build_vector_index(chunks, str(tmp_path / "index"), lists=40)
    one = questions.where("question_id = 'q3'")
    probed = {r.list for r in vi.choose_lists(one, index, 4).collect()}
    assert len(probed) == 4
    plan = vi.search_vectors(one, index, probes=4)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN \(", plan)


def test_recall_on_clustered_vectors(spark, tmp_path):
    """Vectors around 60 centres, as embeddings of related texts lie: an eighth of the lists holds nearly all neighbours."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 32))
    rows = [("a" if i % 3 else "b", i, (centres[i % 60] + 0.25 * rng.normal(size=32)).tolist()) for i in range(3000)]
    asked = [(f"q{i}", "a" if i % 2 else "b", (centres[i % 60] + 0.25 * rng.normal(size=32)).tolist()) for i in range(300)]
    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    index = vi.build_vector_index(chunks, str(tmp_path / "index"))
    assert vi.recall(vi.search_vectors(questions, index, probes=7), retrieve_chunks(questions, chunks)) >= 0.9


def test_odd_vectors(spark, tmp_path):
    rows = [("a", i, [float(i), 0.0]) for i in range(30)] + [("a", 100, [1.0]), ("a", 101, [2.0]), ("a", 102, None), ("a", 103, []), ("a", 104, [1.0, None]), ("b", 1, [5.0, 5.0]), ("a", 3, [3.0, 0.0])]
    asked = [("q1", "a", [3.1, 0.0]), ("q2", "a", [1.9]), ("q3", "b", [0.0, 0.0]), ("q4", "none", [1.0, 1.0]), ("q5", "a", None), ("q6", "a", [1.0, 2.0, 3.0])]
    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    index = vi.build_vector_index(chunks, str(tmp_path / "index"), lists=5)
    for probes in (None, 50):
        assert key(vi.search_vectors(questions, index, 3, probes).collect()) == key(retrieve_chunks(questions, chunks, 3).collect())
    one = vi.search_vectors(questions, index, 2, probes=1).collect()
    assert {(r.question_id, r.chunk_id) for r in one if r.question_id in ("q2", "q3")} == {("q2", 101), ("q2", 100), ("q3", 1)}
    assert key(vi.search_vectors(questions.where("false"), index).collect()) == []


def test_no_rows(spark, tmp_path):
    index = vi.build_vector_index(spark.createDataFrame([], CHUNK), str(tmp_path / "index"))
    questions = spark.createDataFrame([("q", "a", [1.0])], QUESTION)
    assert len(index.centroids) == 0 and vi.search_vectors(questions, index).collect() == []


def test_one_list_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "FILE_ROWS", 100)
    rows = [("a", i, [1.0, float(i % 3)]) for i in range(1000)]
    index = vi.build_vector_index(spark.createDataFrame(rows, CHUNK), str(tmp_path / "index"), lists=1)
    assert len(index.chunks(spark).inputFiles()) > 3
    got = vi.search_vectors(spark.createDataFrame([("q", "a", [1.0, 0.0])], QUESTION), index, 4)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [0, 3, 6, 9]


def test_centroids_against_plain_rounds():
    rng = np.random.default_rng(0)
    vectors, centroids = rng.normal(size=(500, 6)), rng.normal(size=(9, 6))
    want = np.argmin(((vectors[:, None] - centroids) ** 2).sum(axis=2), axis=1)
    assert np.array_equal(vi.assign(vectors, centroids, 64), want) and len(vi.assign(vectors[:0], centroids)) == 0


def test_all_lists_are_met_gathered(spark, tmp_path):
    """A question that searches all lists is one row for each cell of lists, not one for each list."""
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else "b", i, rng.normal(size=8).tolist()) for i in range(600)]
    chunks = spark.createDataFrame(rows, CHUNK)
    index = vi.build_vector_index(chunks, str(tmp_path / "index"), lists=24)
    for size, most in ((vi.CELL_ROWS, 1), (100, 5)):
        cells = vi.gathered_lists(index, spark, size).collect()
        assert len({(r.repo_id, r.list) for r in cells}) == len(cells) > 24
        assert all(len({r.cell for r in cells if r.repo_id == repo}) <= most for repo in "ab")
    questions = spark.createDataFrame([(f"q{i}", "ab"[i % 2], rng.normal(size=8).tolist()) for i in range(20)], QUESTION)
    assert key(vi.search_vectors(questions, index, probes=None).collect()) == key(retrieve_chunks(questions, chunks).collect())
