import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import naming, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


PIECES = ["a", "b é", "\n", "\r", "\r\n", "", " ", "\t", "x\u2028y", "\x85", "\x1c", "\x0b", "/", "."]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def test_lines_agree_with_universal_newlines(spark, tmp_path):
    texts = ["a\r\nb\n", "", "a", "\n", "\n\n", *random_texts(300, 1)]
    want = []
    for t in texts:
        p = tmp_path / "t"
        p.write_bytes(t.encode())
        with open(p, encoding="utf-8") as f:
            want.append([line.rstrip("\n") for line in f.readlines()])
    assert column(spark, texts, text.lines_array) == want
    assert column(spark, texts, text.line_count) == [len(w) for w in want]


def test_wide_lines_agree_with_splitlines(spark):
    texts = ["", "a\x0bb", *random_texts(300, 2)]
    assert column(spark, texts, text.wide_lines_array) == [t.splitlines() for t in texts]


def test_strip_agrees(spark):
    values = ["".join(random.Random(i).choices(["\u3000", "\xa0", "\x1c", " ", "q", "\u200b"], k=6)) for i in range(200)]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.char_indent) == [len(v) - len(v.lstrip()) for v in values]


def test_extension_and_stem_agree(spark):
    names = [".env", "prod.env", "x.tar.gz", "a.PY", "..a.py", "a", "a.", "...", "d.x/e", "d/.x.y", "é.Py"]
    assert column(spark, names, text.extension) == [os.path.splitext(os.path.basename(n))[1].lower() for n in names]
    assert column(spark, names, text.stem) == [os.path.splitext(os.path.basename(n))[0] for n in names]


def test_path_helpers(spark):
    assert column(spark, ["./.github/x.py", "a/b", "../c"], text.strip_dot_slash) == ["github/x.py", "a/b", "c"]
    assert column(spark, ["\\\\a\\b", "//c"], text.normal_path) == ["a/b", "c"]
    got = column(spark, ["a/../b", "../b", "a\\b", "/a/./b", "a/../../b"], text.safe_rel_path)
    assert [(g.path, g.error is not None) for g in got] == [("b", False), (None, True), ("a/b", False), ("a/b", False), (None, True)]


def test_lossy_decode_agrees(spark):
    rng = random.Random(3)
    raw = [bytes(rng.choices([0x61, 0xC3, 0xA9, 0xFF, 0xF0, 0x9F, 0x98, 0x80, 0xEF, 0xBF, 0xBD, 0xEE, 0x80, 0xE2, 0x28], k=rng.randint(0, 10)))
           for _ in range(500)]
    raw += ["\ue000a\ufffd".encode() + b"\xff", b"\xed\xa0\x80x", b"\xc0\xaf"]
    assert column(spark, [bytearray(b) for b in raw], text.decode_utf8, "binary") == [b.decode("utf-8", "ignore") for b in raw]


@pytest.mark.parametrize("url,full", [
    ("https://localhost/evil/repo.git", None),
    ("http://github.com/o/r", None),
    ("https://github.com/o/r.git", "o/r"),
    ("https://WWW.GitHub.com/o/r/", "o/r"),
    ("https://github.com/o/r/tree/main", None),
    ("https://github.com/o", None),
    ("https://github.com/o/.git", None),
    ("HTTPS://user:pw@github.com:443/o//r?x=1#f", "o/r"),
    ("  https://github.com/o/r.git  ", "o/r"),
    ("https://evil.com/@github.com/o/r", None),
    ("", None),
    (None, None),
])
def test_repo_url(spark, url, full):
    got = column(spark, [url], naming.parse_repo_url)[0]
    assert got.full_name == full
    assert (got.error is None) == (full is not None)
    assert got.normalized_url == (full and f"https://github.com/{full}")


def test_labels(spark):
    df = spark.createDataFrame(
        [("JavaScript", "src/api/x.js"), ("Python", "a/Big.Name.py"), ("PHP", "a/fooBAR.php"), ("Vue", "apis/v.vue"), ("Perl", "a.pl")],
        "l string, p string",
    )
    got = [tuple(r) for r in df.select(naming.suggested_framework("l", "p"), naming.test_file_name("l", "p")).collect()]
    assert got == [
        ("Supertest + Vitest", "x.test.js"), ("pytest", "test_Big.Name.py"), ("PHPUnit", "FoobarTest.php"),
        ("Vitest + Vue Test Utils", "v.spec.ts"), ("language-appropriate unit tests", "a.test.txt"),
    ]


def test_blob_url(spark):
    df = spark.createDataFrame(
        [("https://github.com/o/r.git", "a b", "x\\y z!*'()~.py", 3), ("https://github.com/o/r/", "", "/a//b", 0), ("", "m", "a", 1), ("u", "m", "/", 1)],
        "u string, b string, p string, n int",
    )
    assert [r[0] for r in df.select(naming.blob_url("u", "b", "p", "n")).collect()] == [
        "https://github.com/o/r/blob/a%20b/x/y%20z!*'()~.py#L3", "https://github.com/o/r/blob/main/a/b", None, None,
    ]


def test_bands_steps_names(spark):
    assert column(spark, [None, -1, 59, 60, 79, 80, 900], naming.score_band, "int") == [
        "Needs attention", "Needs attention", "Needs attention", "Needs review", "Needs review", "Healthy", "Healthy"]
    assert column(spark, ["failed", "complete", "building_index", "cloning"], lambda c: naming.step_state(F.lit("building_index"), c)) == [
        "pending", "done", "active", "pending"]
    assert column(spark, ["--a b/é_", "///", "x"], naming.safe_file_name) == ["a-b-é_", "repository", "x"]
