"""Quality rules against plain Python; classifier and language identification by held-out accuracy; odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language_id as li
from corpuslens.llm import quality_classifier as qc
from corpuslens.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


@pytest.mark.parametrize("which", ["odd", "documents", "no_rows"])
def test_base_measures(request, which):
    docs = request.getfixturevalue(which)
    got = qr.quality_rules(docs, order=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    ).collect()
    want = [(r.doc_id, *base(r.text)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_order_changes_no_verdict(documents):
    plain = qr.quality_rules(documents, order=False).select("doc_id", "kept").collect()
    ordered = qr.quality_rules(documents).select("doc_id", "kept").collect()
    assert sorted(plain) == sorted(ordered)
    assert {r.kept for r in plain} == {True, False}


def test_cheap_rejecting_rules_come_first(documents):
    slow = F.size(F.filter(F.transform(F.col("_q.words"), lambda w: F.sha2(F.repeat(w, 200), 512)), lambda w: w == "")) > 0
    rules = [qr.Rule("slow_and_useless", slow), *qr.standard_rules()]
    assert qr.cascade_order(documents, rules)[-1].name != "symbols"
    assert qr.cascade_order(documents, rules)[0].name != "slow_and_useless"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(larger):
    docs, labels = larger
    got = qc.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted for r in got if r.quality == 1) >= 0.98 * len(good)


def test_language_held_out(larger):
    got = li.identify_languages(larger[0]).join(larger[0].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.03 * len(got)


def test_language_of_odd_rows(odd, no_rows):
    assert li.identify_languages(no_rows).collect() == []
    got = {r.doc_id: r for r in li.identify_languages(odd).collect()}
    assert len(got) == 10
    assert all(got[k].lang_pred == "und" and got[k].rejected for k in (2, 3, 6)) and got[1].lang_pred != "und"
    assert not got[None].held_out
    kept = li.keep_identified(odd, odd)
    assert kept.columns == odd.columns


def test_quality_of_odd_rows(odd, no_rows, labels):
    assert qc.classify_quality(no_rows, labels).collect() == []
    few = labels.where("doc_id < 0")
    got = qc.classify_quality(odd, few).collect()
    assert len(got) == 11 and {r.score for r in got} == {0.5}
    marks = odd.selectExpr("doc_id", "if(doc_id in (4, 8), 0, 1) AS quality").unionByName(few.select("doc_id", "quality"))
    got = qc.classify_quality(odd, marks).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert qc.keep_good(odd, odd, marks).columns == odd.columns


def plain_features(text):
    """The hashed features of a text, character by character and word by word."""
    code = [10, *[c if not (c == 32 or 9 <= c <= 13) else 32 for c in map(ord, text or "")], 10]
    code = [32 if c == 10 else c for c in code]
    word = lambda cs: sum(c * pow(0x01000193, i + 1, 1 << 32) for i, c in enumerate(cs)) % (1 << 32)
    bucket = lambda h: (h % (1 << 32) * 0x9E3779B1) % (1 << 32) >> (32 - qc.BITS)
    grams = []
    for n in qc.NGRAMS:
        for i in range(len(code) - n + 1):
            part = code[i : i + n]
            if all(c != 32 for c in part[1:-1]) and (n > 2 or part != [32, 32]):
                h = 0
                for c in part:
                    h = (h * 0x01000193 + c) % (1 << 32)
                grams.append(bucket(h + n * 40503))
    words = [word(map(ord, w)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [bucket((7 if a == b else a * 31 + b) * 0x01000193 + 13) for a, b in zip(words, words[1:])]
    return [Counter(grams), Counter(map(bucket, words)), Counter(pairs)]


TEXTS = ["ab ab cd", None, "", "x", "  ", "ab ab cd", "wörd 日本 " * 40 + "end", "one\ntwo\tthree", "tail"]


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_features_against_plain_python(piece):
    """Whatever the pieces that a text passes in: its features, and the score as their weighted mean."""
    texts = pa.array(TEXTS)
    for text, (ids, weights) in zip(TEXTS, qc.merged(texts, piece)):
        want = Counter()
        for kind in plain_features(text):
            for f, n in kind.items():
                want[f] += n / kind.total() / qc.KINDS
        got = Counter()
        for f, w in zip(ids.tolist(), weights.tolist()):
            got[f] += w
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-6 for f in got)
    model = qc.Model(np.random.default_rng(0).normal(size=1 << qc.BITS).astype(np.float32), 0.25)
    for text, score in zip(TEXTS, model.score(texts, piece)):
        total = 0.25 + sum(sum(model.weights[f] * n for f, n in kind.items()) / kind.total() for kind in plain_features(text) if kind) / qc.KINDS
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-6


def test_scores_are_the_trained_model_on_every_text(larger):
    """The whole query against a plain loop over texts with the same training rows."""
    docs, labels = larger
    rows = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    picked = sorted(k for k in marks if k in rows)
    assert len(picked) < qc.SAMPLE_ROWS
    model = qc.train(list(qc.merged(pa.array([rows[k] or "" for k in picked]))), [marks[k] for k in picked])
    got = {r.doc_id: r for r in qc.classify_quality(docs, labels).collect()}
    for doc, text in list(rows.items())[::7]:
        total = model.bias + sum(sum(model.weights[f] * n for f, n in kind.items()) / kind.total() for kind in plain_features(text) if kind) / qc.KINDS
        assert abs(got[doc].score - 1 / (1 + np.exp(-total))) < 1e-4
        assert got[doc].predicted == int(got[doc].score >= 0.3)


def test_quality_learns_from_the_end_of_long_texts(spark):
    """What marks a text stands only beyond 20,000 characters."""
    rng = random.Random(4)
    same = [" ".join(rng.choices(["some", "plain", "words", "of", "text"], k=5000)) for _ in range(60)]
    rows = [(i, body + (" zq" if i % 2 else " xk") * 300) for i, body in enumerate(same)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = qc.classify_quality(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality")).where("held_out").collect()
    assert len(got) > 5 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_language_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(4)
    words = {"aa": ["zqko", "quzz", "zokq"], "bb": ["mila", "lami", "imal"]}
    rows = []
    for i in range(40):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, "".join(rng.choices("etaoin", k=6000)) + " " + " ".join(rng.choices(words[lang], k=400)), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = li.learn(docs, F.lit(True))
    assert b"zqko quzz" in learned["aa"] and b"mila lami" in learned["bb"]
    found = li.Languages(learned)
    assert [found.decide(" ".join(rng.choices(words[k], k=30)))[0] for k in ("aa", "bb")] == ["aa", "bb"]


def test_dictionaries_take_blocks_from_everywhere(spark):
    """More text than a dictionary holds: no row and no part of a row is left out for its place."""
    rows = [(i, " ".join(f"r{i}p{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(3000)), "x") for i in range(20)]
    learned = li.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), dictionary_bytes=64 << 10)["x"].decode()
    assert 50_000 < len(learned) <= (64 << 10)
    seen = {w.split("p")[0] for w in learned.split()}
    late = [w for w in learned.split() if len(w.split("p")[-1]) == 4 and w.split("p")[-1][0] == "c"]
    assert len(seen) >= 18 and late


@pytest.mark.parametrize("text", ["½", "² ³", "\u2167", "12 ½ _ \u2167", "٣", "①", "🙂 ½"])
def test_no_letter_is_und(text):
    found = li.Languages({"en": b"some words", "de": b"ein paar"})
    assert found.decide(text)[:2] == ("und", 0.0) and found.decide(text + " a")[0] != "und"


def test_languages_against_coding_outside_spark(larger):
    """Every text coded block by block with the same dictionaries."""
    import zstandard

    docs, _ = larger
    learned = li.learn(docs, li.fold(F.col("doc_id")) != 0)
    got = {r.doc_id: r for r in li.identify_languages(docs).collect()}
    content = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in learned.items()}
    for row in docs.where("doc_id % 5 = 0").collect():
        clean = re.sub(r"[^\w\s]+|[\d_]+", " ", (row.text or "").lower()).strip()
        if not any(map(str.isalpha, clean)):
            assert got[row.doc_id].lang_pred == "und"
            continue
        sizes = {k: 0 for k in content}
        for i in range(0, len(clean), li.BLOCK_CHARS):
            for k in content:
                coder = zstandard.ZstdCompressor(compression_params=li._parameters(), dict_data=content[k])
                sizes[k] += len(coder.compress(clean[i : i + li.BLOCK_CHARS].encode()))
        assert sizes[got[row.doc_id].lang_pred] <= 1.01 * min(sizes.values())


def test_clashing_names_are_kept(spark, labels, documents):
    docs = documents.selectExpr("*", "'a' AS __quality", "'b' AS verdict", "'c' AS __language", "'d' AS _verdict")
    for kept in (qc.keep_good(docs, docs, labels), li.keep_identified(docs, docs)):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.select("__quality", "verdict", "__language", "_verdict").collect()} == {("a", "b", "c", "d")}


def test_sample_of_the_rules_is_of_the_whole_table(spark):
    """Rows at the end of the table decide the order too, and no column depends on it."""
    rows = [(i, "plain words " * 10 + "and then more of them follow here " if i < 1500 else "a$b$ " * 2 + "words of all kinds in one line of text here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    rules = [qr.Rule("never", F.lit(False)), *qr.standard_rules()]
    got = qr.cascade_order(docs, rules, sample_rows=300)
    assert got[0].name == "symbols"
    assert "rejected_by" not in qr.quality_rules(docs, order=False).columns
