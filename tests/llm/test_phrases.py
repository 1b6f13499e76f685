"""Collocations against counts in plain Python: given rows, odd rows, heavy pairs, and the sort by itself."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import phrases as ph
from corpuslens.llm.common import segments

SMALL = {"bits": 12, "heavy": 40, "group_rows": 1}


def brute_force(rows, least, percent=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + d]) for d in range(1, 6) for i in range(len(w) - d + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = Counter()
    for (lang, *w), a in found.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                inside[lang, *w[i : i + d]] = max(inside[lang, *w[i : i + d]], a)
    out = []
    for (lang, *w), a in found.items():
        if 100 * inside[lang, *w] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    ranked, places = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        places[lang] += 1
        if places[lang] <= top:
            ranked.append((lang, places[lang], phrase.decode(), -a, left, right, total, -score))
    return ranked


def compare(frame, least, top=2000, percent=100, **sizes):
    got = ph.collocations(frame, least, percent, top, **sizes)
    want = brute_force([(r.lang, r.text) for r in frame.select("lang", "text").collect()], least, percent, top)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def test_given_rows(documents):
    assert len(compare(documents, 20)) > 50


@pytest.mark.parametrize("percent", [100, 60])
def test_heavy_pairs_small_sketch_and_chunks(spark, percent):
    rng = random.Random(3)
    words = ["the", "of", "a", "Und", "été", "x" * 50, "日本", "0"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, [9, 5, 3, 2, 1, 1, 1, 1], k=rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, "und"]), text.replace("a", ", a") if i % 3 else "the of the of the of\tthe of.\n" * 3 + text))
    compare(spark.createDataFrame(rows, "lang string, text string").repartition(5), 10, top=25, percent=percent, **SMALL)


def test_odd_rows(odd, no_rows):
    assert ph.collocations(no_rows).collect() == []
    want = compare(odd.withColumn("rank", odd.score).withColumn("word", odd.score), 2, **SMALL)
    assert ("en", "tie tie") in [(r[0], r[2]) for r in want]  # its longest runs are one fewer
    assert "und" in {r[0] for r in compare(odd, 1, top=3)}


def test_long_text_in_segments(spark):
    """Several runs of one text: pieces end at the cuts, so nothing is lost or joined."""
    text = "".join(f"w{i % 7} w{i % 11} tail{i % 3}{'.,;:!?'[i % 6]}" for i in range(200_000))
    compare(spark.createDataFrame([("en", text), ("en", "one stretch " * 300_000)], "lang string, text string"), 1000)


def test_segments_cover_the_texts():
    texts = pa.array(["abc.def", None, "", "x" * 50, "a.b.c.d.e.f.g.h." * 5, "é." * 9, "."])
    for limit in (1, 2, 7, 16, 1000):
        parts = {}
        for raw, bounds, rows in segments(texts, b".", limit):
            assert bounds[0] == 0 and bounds[-1] == len(raw)
            for i, row in enumerate(rows):
                parts.setdefault(int(row), []).append(bytes(raw[bounds[i] : bounds[i + 1]]))
        for row, text in enumerate(texts.to_pylist()):
            assert b"".join(parts[row]).decode() == (text or "")
            assert all(p.endswith(b".") for p in parts[row][:-1])
    assert list(segments(pa.array([], pa.string()), b".")) == []


def test_multikey_counts_all_prefixes():
    rng = np.random.default_rng(1)
    symbols = rng.zipf(1.6, (4000, 4)).clip(0, 30)
    symbols[rng.random(4000) < 0.3, 2:] = 0
    symbols[:, 0] = np.sort(symbols[:, 0])
    weight = rng.integers(1, 5, 4000)
    starts = np.flatnonzero(np.append(True, np.diff(symbols[:, 0])))
    got = {}
    for rows, depth, total in ph.multikey_counts(symbols, weight, starts, np.full(len(starts), 25)):
        got |= {tuple(symbols[r, :depth].tolist()): int(t) for r, t in zip(rows, total)}
    want = Counter()
    for row, w in zip(symbols.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    assert got == {k: v for k, v in want.items() if v >= 25}
