"""Listing, reading and writing trees: empty files, hidden names, links, splitting of the walk, odd names."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslens.operators.files import repo_facts, repo_gate, repo_stats
from corpuslens.sources.tables import scan_files
from corpuslens.sources.tree import TreeReader, list_tree, read_tree, walk, open_tree, write_tree


def make(root, files):
    for path, data in files.items():
        target = os.path.join(os.fsencode(root), path if isinstance(path, bytes) else path.encode())
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as out:
            out.write(data)


def expected(root):
    """Every file and link, by a plain walk."""
    out = set()
    for folder, folders, names in os.walk(root):
        for name in [*names, *[f for f in folders if os.path.islink(os.path.join(folder, f))]]:
            full = os.path.join(folder, name)
            parts = os.path.relpath(full, root).split(os.sep)
            if len(parts) > 1:
                link = os.path.islink(full)
                out.add((parts[0], "/".join(parts[1:]), 0 if link else os.path.getsize(full), link))
    return out


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root with space"
    make(root, {
        "r1/a.py": b"x = 1\n", "r1/__init__.py": b"", "r1/tests/__init__.py": b"", "r1/README.md": b"", "r1/.github/ci.yml": b"on: push\n",
        "r1/_private/deep/er/x.py": b"y", "r2/empty.py": b"", "r3/bad.py": b"a\xffb", "top.txt": b"above", "r4/only/folders/here/.keep": b"",
    })
    os.symlink("/etc/passwd", root / "r1/outside")
    os.symlink(root / "r1", root / "r2/whole")
    os.symlink("nowhere", root / "r1/broken.py")
    os.makedirs(root / "r5/no/files")
    return root


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_listing_in_rounds(spark, tree, most):
    got = list_tree(spark, str(tree), folders_per_task=most)
    assert {(r.repo_id, r.path, r.size_bytes, r.is_symlink) for r in got.collect()} == expected(str(tree))
    assert got.count() == len(expected(str(tree)))


@pytest.mark.parametrize("uri", [False, True])
def test_contents(spark, tree, uri):
    files = scan_files(spark, ("file://" + str(tree).replace(" ", "%20")) if uri else str(tree))
    got = {(r.repo_id, r.path): r for r in files.collect()}
    assert len(got) == len(expected(str(tree)))
    assert got["r3", "bad.py"].content == "ab" and not got["r3", "bad.py"].utf8_valid and got["r3", "bad.py"].size_bytes == 3
    assert got["r1", "outside"].is_symlink and got["r1", "outside"].content == ""
    assert got["r1", "__init__.py"].content == "" and got["r1", "_private/deep/er/x.py"].content == "y"
    names = scan_files(spark, str(tree), content=False)
    assert names.where("content IS NOT NULL").isEmpty() and names.count() == len(got)


def test_empty_files_count(spark, tree):
    """A package of empty files is code, an empty README is documentation, and a link is a reason to refuse."""
    files = scan_files(spark, str(tree))
    stats = {r.repo_id: r for r in repo_stats(files.where("NOT is_symlink")).collect()}
    assert stats["r1"].file_count == 4 and stats["r1"].lines_of_code == 2 and stats["r2"].file_count == 1
    facts = {r.repo_id: r for r in repo_facts(files).collect()}
    assert facts["r1"].has_docs
    gate = {r.repo_id: r.reject_reason for r in repo_gate(files).collect()}
    assert "link" in gate["r1"].lower() and gate["r3"] is None


def test_one_folder_is_dealt_to_many(spark, tmp_path):
    """A first-level folder with nearly all folders: its walker stops early, and the rest comes back as folder rows."""
    make(tmp_path, {f"big/d{i}/e{j}/f.py": b"1" for i in range(20) for j in range(5)} | {"small/x.py": b"2"})
    reader = TreeReader({"path": str(tmp_path), "foldersPerTask": "10"})
    assert [p.places for p in reader.partitions()] == [[b"big"], [b"small"]]
    rows = [r for batch in reader.read(reader.partitions()[0]) for r in batch.to_pylist()]
    assert sum(r["is_folder"] for r in rows) >= 11
    assert list_tree(spark, str(tmp_path), folders_per_task=10).count() == 101
    assert [len(p.places) for p in TreeReader({"path": str(tmp_path), "partitions": "1"}).partitions()] == [2]


def test_names_that_are_no_text_and_repositories_below(spark, tmp_path):
    make(tmp_path, {b"o/r/caf\xe9.py": b"1", "o/r/日本/ü.py": b"22", "o/loose.txt": b"3"})
    got = {(r.repo_id, r.path, r.raw) for r in read_tree(spark, str(tmp_path), repo_depth=2).collect()}
    assert got == {("o/r", "caf\ufffd.py", b"1"), ("o/r", "日本/ü.py", b"22")}


def test_no_rows_and_gone_files(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).collect() == []
    assert scan_files(spark, str(tmp_path / "missing")).collect() == []
    make(tmp_path, {"r/a": b"1", "r/b": b"2"})
    files = read_tree(spark, str(tmp_path))
    (tmp_path / "r/a").unlink()
    assert [r.path for r in files.collect()] == ["b"]
    os.mkfifo(tmp_path / "r/pipe")
    assert [r[1] for r in walk(open_tree(str(tmp_path)), [b"r"], 1, 10)] == ["b"]
    with pytest.raises(ValueError):
        open_tree("nosuchscheme://x/y")


def test_round_trip(spark, tmp_path):
    rows = [("r", "a/b.txt", "text é\n"), ("r", "empty", ""), ("q", "null", None), ("q", "_x/.y", "z" * 100_000)]
    frame = spark.createDataFrame(rows, "repo_id string, path string, content string").withColumn("size_bytes", F.lit("clash"))
    written = write_tree(frame, str(tmp_path))
    assert {(r.repo_id, r.path): r.size_bytes for r in written.collect()}["r", "a/b.txt"] == 8
    assert {(r.repo_id, r.path, r.content) for r in scan_files(spark, str(tmp_path)).collect()} == {(a, b, c or "") for a, b, c in rows}
    bad = spark.createDataFrame([("r", "../../x", "y")], "repo_id string, path string, content string")
    with pytest.raises(Exception, match="no path inside"):
        write_tree(bad, str(tmp_path))
