"""The chunk index over several updates: what is rewritten, which vectors stay, and what a reader sees."""

import os

from pyspark.sql import functions as F

from corpuslens.operators import chunk_store as cs
from corpuslens.operators.chunks import build_chunk_index, chunk_files


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def index(spark, path):
    return {(r.repo_id, r.chunk_id): r for r in cs.read_chunk_index(spark, path).collect()}


def test_updates_rewrite_what_differs(spark, make_files, tmp_path):
    path = str(tmp_path / "index")
    texts = {(f"r{i % 3}", f"src/f{i}.py"): f"def a{i}():\n    return {i}\n\ndef b{i}():\n    return 0\n" for i in range(60)}
    rows = lambda: [(r, p, c) for (r, p), c in texts.items()]
    first = cs.update_chunk_index(chunk_files(make_files(*rows())), path)
    assert first.added == cs.read_chunk_index(spark, path).count() and first.same == first.removed == 0
    want = {(r.repo_id, r.chunk_id): r.content for r in build_chunk_index(make_files(*rows())).collect()}
    assert {k: r.content for k, r in index(spark, path).items()} == want

    vectors = cs.without_vectors(spark, path).select("repo_id", "hash", F.array(F.char_length("content").cast("float"), F.lit(1.0)).alias("embedding"))
    assert cs.set_vectors(vectors, path) == first.buckets and cs.without_vectors(spark, path).isEmpty()

    before = files_of(path)
    again = cs.update_chunk_index(chunk_files(make_files(*rows())), path)
    assert again.buckets == [] and again.same == first.added and files_of(path) == before

    texts["r1", "src/f1.py"] = "# new first line\n" + texts["r1", "src/f1.py"].replace("return 1", "return 111")
    one = cs.update_chunk_index(chunk_files(make_files(*rows())), path)
    assert len(one.buckets) == 1
    after = files_of(path)
    assert all(f"bucket={one.buckets[0]}/" in f for f in before.keys() ^ after.keys())
    got = index(spark, path)
    assert {k: r.content for k, r in got.items()} == {(r.repo_id, r.chunk_id): r.content for r in build_chunk_index(make_files(*rows())).collect()}
    fresh = [r for r in got.values() if r.embedding is None]
    assert {r.file_path for r in fresh} == {"src/f1.py"} and all(r.embedding[0] == len(r.content) for r in got.values() if r.embedding)

    del texts["r2", "src/f2.py"]
    gone = cs.update_chunk_index(chunk_files(make_files(*rows())), path)
    assert gone.removed >= 1 and gone.added == gone.changed == 0 and "src/f2.py" not in {r.file_path for r in index(spark, path).values()}


def test_moved_content_keeps_its_vector_and_other_repositories_stay(spark, make_files, tmp_path):
    path = str(tmp_path / "index")
    cs.update_chunk_index(chunk_files(make_files(("a", "x.py", "text one\n"), ("b", "y.py", "text two\n"))), path, buckets=1)
    cs.set_vectors(cs.without_vectors(spark, path).withColumn("embedding", F.array(F.lit(7.0))), path)
    moved = cs.update_chunk_index(chunk_files(make_files(("a", "lib/z.py", "text one\n"))), path, buckets=1)
    assert moved[:4] == (1, 1, 0, 0)
    assert {(r.repo_id, r.file_path, tuple(r.embedding)) for r in index(spark, path).values()} == {("a", "lib/z.py", (7.0,)), ("b", "y.py", (7.0,))}
    none = make_files(("a", "empty.py", ""))
    cleared = cs.update_chunk_index(chunk_files(none), path, none.select("repo_id"), buckets=1)
    assert cleared.removed == 1 and [r.repo_id for r in index(spark, path).values()] == ["b"]


def test_no_rows(spark, make_files, tmp_path):
    path = str(tmp_path / "index")
    empty = chunk_files(make_files(("a", "x.py", "t\n"))).where("false")
    assert cs.update_chunk_index(empty, path) == cs.Update(0, 0, 0, 0, []) and index(spark, path) == {}
    assert cs.set_vectors(cs.without_vectors(spark, path).withColumn("embedding", F.array(F.lit(1.0))), path) == []
