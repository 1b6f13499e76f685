"""Licence notices in texts by a trained paragraph classifier.

A paragraph is a run of lines that hold words; a line without words ends it. Lines, and whole paragraphs across their
line feeds, are read in overlapping windows of words, long ones for bodies and short ones for notices inside prose. A
logistic regression over sparse hashed word 1- to 3-grams, trained in numpy, gives each window a family or ``unknown``.
It learns from templates with random edits, from templates inside prose, from
sentences that merely use the words of licences, and, as unknown, from a bounded sample of the corpus's own lines
that resemble no template. On parts held back, a temperature calibrates the probabilities and the acceptance
threshold is set above nearly all unknown lines. An accepted prediction must then be confirmed by a template of its
family: the share of the template's word pairs that a stretch of the window holds. A notice is reported once, at the
line its stretch starts in; of stretches that share most of their words the one most alike stays.

A text longer than ``PIECE_BYTES`` is read in pieces that overlap by more than any template takes; each piece reports the
notices that start nearer to its middle, so memory has a bound whatever the length of a text, and none is lost or told
twice. NULL and empty texts have no paragraph. Repeated rows are reported each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import slabs, utf8
from corpuslens.llm.license_templates import OTHER, TEMPLATES

BITS = 15
WINDOW, STRIDE = 40, 20
#: Windows over paragraphs, (words, stride).
WINDOWS = ((WINDOW, STRIDE), (12, 3), (6, 2))
#: Share of a template's word pairs that confirms it.
CONFIRM = 0.7
#: Rows of the corpus that unknown is learned from, and windows of ``WINDOW`` words of their lines. A window with more
#: characters than ``SAMPLE_CHARS`` holds no words of a licence and is not taken.
SAMPLE_ROWS, SAMPLE_LINES, SAMPLE_CHARS = 300, 1200, 4000
#: Bytes of text that are worked on at a time, and half of what the pieces of a longer text share.
PIECE_BYTES, HALF_OVERLAP = 1 << 20, 1 << 13
COPIES, EPOCHS, STEP = 30, 6, 0.5
#: Of the unknown lines held back, the share whose best family may exceed the threshold.
FALSE_SHARE = 0.002
FAMILIES = [*TEMPLATES, "unknown"]
UNKNOWN = len(FAMILIES) - 1
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Words:
    """Words of some texts: hashes, where each starts and ends in the bytes, its text and its line in the text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    line: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, none)
    run = np.maximum(np.cumsum(first) - 1, 0)
    place = np.arange(len(data)) - starts[run]
    at = np.flatnonzero(inside)
    power = np.cumprod(np.full(int(place[at].max()) + 1, K1), dtype=np.uint64)
    term = np.zeros(len(data), np.uint64)
    term[at] = (lower[at].astype(np.uint64) * K2 + np.uint64(1)) * power[place[at]]
    hashes = np.add.reduceat(term, starts)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * K2
    ends = starts + np.bincount(run[at], minlength=len(starts))
    doc = np.searchsorted(offsets, starts, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    return Words(hashes, starts, ends, doc, feeds[starts] - feeds[offsets[doc]])


def windows(first: np.ndarray, last: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of windows over runs of words: one if a run is short, else every ``stride`` words to its end."""
    number = np.maximum(1, -(-(last - first - size) // stride) + 1)
    run = np.repeat(np.arange(len(first)), number)
    start = first[run] + stride * (np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number))
    return start, np.minimum(start + size, last[run])


def grams(hashes: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of 1-, 2- and 3-grams within groups and the word each starts at."""
    shift = np.uint64(64 - BITS)
    out = [((hashes * K1) >> shift, np.arange(len(hashes)))]
    joined = hashes
    for n in (2, 3):
        joined = joined[:-1] * K1 + hashes[n - 1 :] if len(joined) > 1 else joined[:0]
        same = np.flatnonzero(group[: len(joined)] == group[n - 1 : n - 1 + len(joined)])
        out.append(((joined[same] * K1 + np.uint64(n)) >> shift, same))
    return out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one paragraph and their shares."""
    found = split_words(*utf8(pa.array([text])))
    ids = np.concatenate([g for g, _ in grams(found.hashes, found.doc)]) if len(found.hashes) else np.zeros(0, np.uint64)
    ids, counts = np.unique(ids, return_counts=True)
    return ids.astype(np.int64), counts / max(counts.sum(), 1)


def word_pairs(text: str) -> set[tuple[bytes, bytes]]:
    found = _WORD.findall(text.lower().encode())
    return set(zip(found, found[1:]))


_PAIRS = {family: [word_pairs(t) for t in texts] for family, texts in TEMPLATES.items()}


def similarity(pairs: set[tuple[bytes, bytes]], family: str) -> float:
    return max(len(t & pairs) / len(t) for t in _PAIRS[family])


def stretches(words: list[bytes], family: str) -> list[tuple[int, int, float]]:
    """Where templates of a family stand among words: (first word, last word, share of pairs), for shares that confirm."""
    found = []
    for t in _PAIRS[family]:
        hits = [i for i in range(len(words) - 1) if (words[i], words[i + 1]) in t]
        span, spans = len(t) + 1 + max(2, len(t) // 3), []
        while hits:
            # The last of the best starts is the tightest.
            share, first = max((len({(words[j], words[j + 1]) for j in hits if i <= j < i + span - 1}), i) for i in hits)
            if share < CONFIRM * len(t):
                break
            last = max(j for j in hits if j < first + span - 1) + 1
            spans.append((first, last, share / len(t)))
            hits = [j for j in hits if j < first - 1 or j > last]
        if not spans and hits:
            share = len({(words[j], words[j + 1]) for j in hits}) / len(t)
            if share >= CONFIRM:
                spans.append((hits[0], hits[-1] + 1, share))
        found += spans
    return found


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = (logits + self.bias) / self.temperature
        p = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _edited(rng: np.random.Generator, text: str) -> str:
    """A template as it may stand in a text: a name or year around it, a word lost or added, another case."""
    words = text.split(" ")
    if len(words) > 5 and rng.random() < 0.4:
        del words[int(rng.integers(len(words)))]
    if rng.random() < 0.3:
        words.insert(0, f"Copyright (c) {rng.integers(1990, 2030)} Author{rng.integers(99)}.")
    if rng.random() < 0.2:
        words.append(f"See file{rng.integers(99)} for details.")
    joined = " ".join(words)
    return joined.upper() if rng.random() < 0.1 else joined


def _inside_prose(rng: np.random.Generator, unknown: list[str]) -> list[tuple[str, int]]:
    """Windows with a template amid words of unknown texts, and windows of such words alone."""
    words = [w for k in rng.permutation(len(unknown)) for w in unknown[k].split()]

    def prose(n: int) -> list[str]:
        at = int(rng.integers(max(1, len(words) - n)))
        return words[at : at + n]

    out = []
    for f, texts in TEMPLATES.items():
        for text in texts:
            for copy in range(COPIES):
                own = _edited(rng, text).split(" ")
                fits = [w for w, _ in WINDOWS if w > len(own)] or [WINDOW]
                room = max(0, fits[copy % len(fits)] - len(own))
                before = int(rng.integers(room + 1))
                out.append((" ".join(prose(before) + own + prose(room - before)), FAMILIES.index(f)))
    return out + [(" ".join(prose(w)), UNKNOWN) for w, _ in WINDOWS for _ in range(10 * COPIES)]


def train(lines: list[str], seed: int = 5) -> Classifier:
    """From the templates and the corpus lines given as unknown. A fifth of all examples is held back to calibrate."""
    rng = np.random.default_rng(seed)
    examples = [(_edited(rng, t), FAMILIES.index(f)) for f, texts in TEMPLATES.items() for t in texts for _ in range(COPIES)]
    examples += [(t, FAMILIES.index(f)) for f, texts in TEMPLATES.items() for t in texts]
    examples += [(_edited(rng, t), UNKNOWN) for t in OTHER for _ in range(COPIES)]
    pairs = [(line, word_pairs(line)) for line in lines]
    examples += [(line, UNKNOWN) for line, p in pairs if not any(similarity(p, f) >= CONFIRM / 2 for f in TEMPLATES)]
    examples += _inside_prose(rng, [text for text, label in examples if label == UNKNOWN])
    rows = [(*sparse(text), label) for text, label in examples]
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    weights, bias = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    seen = np.full(1 << BITS, 1e-6)
    for _ in range(EPOCHS):
        for k in rng.permutation(used):
            ids, share, label = rows[k]
            logits = share @ weights[ids] + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            seen[ids] += share * share * (p @ p)
            weights[ids] -= (STEP * share / np.sqrt(seen[ids]))[:, None] * p
            bias -= 0.01 * p
    logits = np.array([rows[k][1] @ weights[rows[k][0]] for k in held])
    labels = np.array([rows[k][2] for k in held])

    def loss(temperature: float) -> float:
        p = Classifier(weights, bias, temperature, 0).probabilities(logits)
        return float(-np.log(p[np.arange(len(labels)), labels] + 1e-12).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = Classifier(weights, bias, temperature, 0).probabilities(logits)[labels == UNKNOWN, :UNKNOWN]
    threshold = max(0.5, float(np.quantile(p.max(axis=1), 1 - FALSE_SHARE))) if len(p) else 0.5
    return Classifier(weights.astype(np.float32), bias, temperature, min(threshold, 0.9))


def sample_lines(docs: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> list[str]:
    """Windows of lines of a bounded sample of rows: the rows by a hash of the key, whole; of their windows, wherever in
    a text they stand, those with the smallest hashes."""
    chosen = docs.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(rows)
    keys = [r[key] for r in chosen.collect() if r[key] is not None]
    split = docs.where(F.col(key).isin(keys)).select(F.explode(F.split(text, "\n")).alias("line"))
    words = split.select(F.explode(F.array(F.array_remove(F.split("line", r"\s+"), ""))).alias("w")).where(F.size("w") > 0)
    cut = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW))).alias("i"))
    found = cut.select(F.array_join(F.slice("w", F.col("i"), WINDOW), " ").alias("t")).where(F.length("t") <= SAMPLE_CHARS).distinct()
    return [r["t"] for r in found.orderBy(F.xxhash64("t"), "t").limit(lines).collect()]


def find(model: Classifier, texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, str, float, float]]:
    """(text, line, family, probability, similarity) of confirmed notices; the best stretch of a line and family."""
    data, offsets = utf8(texts)
    if len(texts) != 1 or len(data) <= piece_bytes:
        for doc, line, family, probability, alike, _ in _find(model, data, offsets):
            yield doc, line, family, probability, alike
        return
    best: dict[tuple[int, str], tuple[float, float]] = {}
    start, lines, low = 0, 0, 0
    while True:
        stop = _word_end(data, start + piece_bytes) if start + piece_bytes < len(data) else len(data)
        high = stop - HALF_OVERLAP if stop < len(data) else stop
        for _, line, family, probability, alike, at in _find(model, data[start:stop], np.array([0, stop - start])):
            if low <= start + at < high:
                place = (lines + line, family)
                best[place] = max(best.get(place, (0.0, 0.0)), (alike, probability))
        if stop == len(data):
            break
        # The next piece reports from here on, and starts half an overlap before.
        low, begin = high, _word_end(data, high - HALF_OVERLAP)
        lines += int(np.count_nonzero(data[start:begin] == 10))
        start = begin
    for (line, family), (alike, probability) in sorted(best.items()):
        yield 0, line, family, probability, alike


def _word_end(data: np.ndarray, at: int) -> int:
    """The first white space from ``at`` on, within a quarter of the overlap; else ``at`` itself."""
    space = np.flatnonzero(np.isin(data[at : at + HALF_OVERLAP // 4], (9, 10, 11, 12, 13, 32)))
    return at + int(space[0]) if len(space) else at


def _find(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, str, float, float, int]]:
    """As ``find``, with the byte that the notice starts at as last field."""
    found = split_words(data, offsets)
    n = len(found.hashes)
    if not n:
        return
    # Sums of the weights and numbers of the 1-, 2- and 3-grams that start before each word: a window's are differences.
    total = np.zeros((3, n + 1, len(FAMILIES)), np.float64)
    for k, (ids, at) in enumerate(grams(found.hashes, np.zeros(n, np.int8))):
        total[k, at + 1] = model.weights[ids]
        np.cumsum(total[k], axis=0, out=total[k])
    new_doc = np.append(True, found.doc[1:] != found.doc[:-1])
    step = np.append(1, np.diff(found.line))
    lines, paragraphs = np.flatnonzero(new_doc | (step != 0)), np.flatnonzero(new_doc | (step > 1))
    ends = np.append(paragraphs[1:], n)
    bounds = [windows(lines, np.append(lines[1:], n), WINDOW, STRIDE)]
    bounds += [windows(paragraphs[long], ends[long], *w) for w in WINDOWS for long in [ends - paragraphs > (w[0] if w[0] < WINDOW else 1)]]
    likely_windows: set[tuple[int, int, int, float]] = set()
    for starts, stops in bounds:
        for i in range(0, len(starts), 1 << 16):
            start, end = starts[i : i + (1 << 16)], stops[i : i + (1 << 16)]
            number = np.zeros(len(start))
            scores = np.zeros((len(start), len(FAMILIES)))
            for k in range(3):
                stop = np.maximum(end - k, start)
                scores += total[k, stop] - total[k, start]
                number += stop - start
            p = model.probabilities(scores / number[:, None])
            best = p[:, :UNKNOWN].argmax(axis=1)
            likely = p[np.arange(len(p)), best]
            taken = np.flatnonzero((p.argmax(axis=1) != UNKNOWN) & (likely >= model.threshold))
            likely_windows.update(zip(start[taken].tolist(), end[taken].tolist(), best[taken].tolist(), likely[taken].tolist()))
    places: dict[tuple[int, int, int], tuple[float, float]] = {}
    for start, end, best, likely in sorted(likely_windows):
        words = data[found.starts[start] : found.ends[end - 1]].tobytes().lower()
        for first, last, alike in stretches(_WORD.findall(words), FAMILIES[best]):
            place = (start + first, start + last, best)
            places[place] = max(places.get(place, (0.0, 0.0)), (alike, likely))
    used = np.zeros(n, bool)
    results: dict[tuple[int, int, str], tuple[float, float, int]] = {}
    for (first, last, best), (alike, likely) in sorted(places.items(), key=lambda x: (-x[1][0], x[0][0] - x[0][1], -x[1][1], x[0])):
        if used[first : last + 1].mean() <= 0.5:
            used[first : last + 1] = True
            place = (int(found.doc[first]), int(found.line[first]), FAMILIES[best])
            results[place] = max(results.get(place, (0.0, 0.0, 0)), (alike, likely, int(found.starts[first])))
    for (doc, line_no, family), (alike, probability, at) in sorted(results.items()):
        yield doc, line_no, family, probability, alike, at


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per notice found: ``key``, paragraph (line the notice starts in, from 0), family, probability, similarity."""
    docs = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample_lines(docs, key, text)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for slab in slabs(batch.column(1), PIECE_BYTES):
                rows = list(zip(*find(shared.value, slab))) or [[], [], [], [], []]
                keys = batch.column(0).take(pa.array([at + k for k in rows[0]], pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "paragraph", "family", "probability", "similarity"])
                at += len(slab)

    return docs.mapInArrow(scan, f"`{key}` {docs.dtypes[0][1]}, paragraph int, family string, probability double, similarity double")
