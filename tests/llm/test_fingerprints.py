"""Winnowing against a plain re-statement, edited texts and neighbours against a sorted list."""

import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import fingerprints as fp


def chosen(grams):
    """(hash, pos) of each window of W neighbouring hashes: smallest, rightmost of equal ones, without repeats."""
    out = []
    for i in range(max(1, len(grams) - fp.W + 1) if grams else 0):
        window = list(enumerate(grams[i : i + fp.W], i))
        best = min(window, key=lambda x: (x[1], -x[0]))
        if not out or out[-1] != (best[1], best[0]):
            out.append((best[1], best[0]))
    return out


def test_positions_and_ties(spark):
    texts = ["", "one", "one two", "a b c", "a b c d e f g", "x " * 40, "abcdefghijklmnopqrstuvwxyz", "the cat sat on the mat and the cat sat on the hat " * 3]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    tokens = F.udf(lambda t: re.findall(r"[^\x20\x09-\x0D]{1,8}", t.lower()), "array<string>")
    runs = F.when(F.size("t") >= fp.K, F.transform(F.sequence(F.lit(1), F.size("t") - fp.K + 1), lambda i: F.slice("t", i, fp.K))).when(F.size("t") > 0, F.array("t"))
    plain = frame.withColumn("t", tokens("text")).withColumn("grams", F.transform(runs, lambda x: F.xxhash64(x)))
    grams = {r.i: r.grams or [] for r in plain.collect()}
    for row in fp.with_fingerprint(frame, "text", "fp").collect():
        assert [tuple(x) for x in row.fp] == chosen(grams[row.i])


def test_shared_runs_are_found(spark):
    run = " ".join(f"w{i}" for i in range(fp.K + fp.W - 1))
    frame = spark.createDataFrame([(1, "some words before " + run), (2, run + " and others after it"), (3, "nothing like the rest of these texts")], "i int, text string")
    sets = {r.i: {x.hash for x in r.fp} for r in fp.with_fingerprint(frame, "text", "fp").collect()}
    assert sets[1] & sets[2] and not sets[1] & sets[3]


def expected(rows):
    """doc_id, n_chars, edited_sha256 and the next text of unique keys."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: -r[0])
    out = {}
    for (k, t), (_, other) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), t == other)
    return out


@pytest.mark.parametrize("range_rows", [7, 50, 1000])
def test_neighbours(documents, range_rows):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = expected(rows)
    got = fp.fingerprint_documents(documents, range_rows=range_rows).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    prints = {}
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if want[r.doc_id][2]:
            assert r.near_next == 1
        elif r.n_chars > 300:
            assert r.near_edited > r.near_next
    assert len(set(prints.values())) == len(prints)
    # Half of the text is kept: about a third of all hashes, less only where words repeat.
    assert 0.25 < statistics.median(r.near_edited for r in got if r.n_chars > 300) < 0.45


def test_odd_rows(odd, no_rows, spark):
    assert fp.fingerprint_documents(no_rows).collect() == []
    for n in (3, 1000):
        got = fp.fingerprint_documents(odd, range_rows=n).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((r.doc_id for r in odd.collect()), key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[7].fingerprint and by_id[2].n_chars == 0
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[6].fingerprint
    alone = fp.fingerprint_documents(odd.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_nested_ranks(spark):
    ends = list(range(0, 10_000, 3))
    frame = spark.createDataFrame([(v,) for v in [-5, 0, 1, 3, 2999, 3000, 9999, 20_000]], "v bigint")
    for r in frame.select("v", fp._rank(ends, F.col("v"), False).alias("lt"), fp._rank(ends, F.col("v"), True).alias("le")).collect():
        assert (r.lt, r.le) == (sum(e < r.v for e in ends), sum(e <= r.v for e in ends))


def test_fingerprints_tell_where_texts_share_a_run(spark, odd, no_rows):
    """Hashes and positions as they are given: every shared run of K + W - 1 tokens is found at its places in both texts."""
    run = " ".join(f"w{i}" for i in range(fp.K + fp.W - 1))
    frame = spark.createDataFrame([(1, "some words before " + run), (2, run + " and others after it")], "doc_id int, text string").selectExpr("*", "5 AS _t", "6 AS fingerprint")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame).collect()}
    places = {(a.pos, b.pos) for a in got[1] for b in got[2] if a.hash == b.hash}
    assert places and all(a - b == 3 for a, b in places)
    assert len(fp.fingerprints(odd).collect()) == 11 and fp.fingerprints(no_rows).collect() == []
    assert {r.doc_id: len(r.fingerprint) for r in fp.fingerprints(odd).collect()}[3] == 0
