"""Supervised subword embeddings for text quality.

A text is the average of learned vectors of its words, of its pairs of neighbouring words and of the character
n-grams within its words (each of the three kinds has a third of the weight), all hashed into one table; a softmax
over two classes sits on top. Training is plain numpy stochastic gradient descent with per-row step sizes over a
bounded sample of labelled rows. As average and output layer are linear, scoring needs one number for each hashed
feature: the table is multiplied out once and broadcast (1 MB).

NULL and empty texts have no feature and get the score of the bias alone. Without labels of both classes the score
is the share of label 1 (0.5 without labels). Repeated rows score alike. Texts are read whole, in training as in scoring;
a long one passes in pieces that end at white space, so memory follows the longest stretch without any. Input columns of
any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import fold, segments, with_verdict

BITS = 18
NGRAMS = (2, 3, 4)
KINDS = 3
DIMENSIONS = 8
EPOCHS = 4
STEP = 0.5
#: The sample that is learned from: at most so many labelled rows, of which the whole texts are read.
SAMPLE_ROWS = 3000
#: Bytes of text whose features are held at a time: some 100 bytes of arrays for each, in scoring and in learning.
PIECE_BYTES, LEARN_BYTES = 1 << 19, 1 << 18
BLANKS = b" \t\n\x0b\x0c\r"
THRESHOLD = 0.3
PRIME, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * MIX) >> np.uint32(32 - BITS)


#: The last word of a run of texts and the text it belongs to, for the pair that it makes with the first word of the next.
Last = tuple[np.uint32, int] | None


def features(raw: np.ndarray, bounds: np.ndarray, rows: np.ndarray, last: Last = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], Last]:
    """For n-grams, words and pairs: the hashed features of the parts of a run and the text each belongs to.

    A part stands between white space, as a cut text does, so the parts of a text have its own n-grams and words; the
    pair over a cut is made with ``last``.
    """
    parts = [raw[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
    joined = b"\n" + b"\n".join(parts) + b"\n"
    code = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    owner = np.repeat(rows, np.diff(points[bounds]) + 1)  # of code[1:]
    space = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(space, np.uint32(32), code)
    inner = ~space
    gram_ids, gram_docs = [], []

    # Character n-grams: white space may stand at either end, as the mark of a word's bound, never inside.
    rolling = code.copy()
    clear = np.ones(len(code), bool)
    for n in range(2, max(NGRAMS) + 1):
        rolling = rolling[:-1] * PRIME + code[n - 1 :]
        if n > 2:
            clear = clear[:-1] & inner[n - 2 : -1]
        else:
            clear = clear[:-1]
        if n in NGRAMS:
            ok = clear & (inner[: len(rolling)] | inner[n - 1 :]) if n == 2 else clear
            at = np.flatnonzero(ok)
            gram_ids.append(_bucket(rolling[at] + np.uint32(n * 40503)))
            gram_docs.append(owner[at])

    # Words: a polynomial hash over each run of other characters, then neighbouring pairs of the same text.
    edge = np.diff(inner.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    kinds = [(np.concatenate(gram_ids), np.concatenate(gram_docs))]
    if len(starts):
        place = np.arange(len(code)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(code)]])))
        power = np.cumprod(np.full(int((ends - starts).max()) + 1, PRIME, np.uint32), dtype=np.uint32)
        term = np.where(inner, code * power[np.minimum(place, len(power) - 1)], np.uint32(0))
        word = np.add.reduceat(term, starts, dtype=np.uint32)
        of = owner[starts - 1]
        here, word_of = word, of
        if last is not None:
            word, of = np.append(last[0], word), np.append(last[1], of)
        pair = of[1:] == of[:-1]
        # A word that repeats the one before it makes the same pair whatever the word is.
        both = np.where(word[1:] == word[:-1], np.uint32(7), word[:-1] * np.uint32(31) + word[1:])[pair]
        kinds += [(_bucket(here), word_of), (_bucket(both * PRIME + np.uint32(13)), of[1:][pair])]
        last = (here[-1], int(word_of[-1]))
    return kinds, last


def merged(texts: pa.Array, piece_bytes: int = LEARN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their weights: shares of their kind, each kind with the same share. The
    features of a long text are merged as its pieces pass."""
    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, last = 0, None

    def finished(stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kind = cells >> BITS
        n = np.bincount(kind - done * KINDS, weights=counts, minlength=KINDS * (stop - done))
        share = (counts / n[kind - done * KINDS] / KINDS).astype(np.float32)
        edge = np.searchsorted(cells, np.arange(done, stop + 1) * KINDS << BITS)
        for i, j in zip(edge[:-1], edge[1:]):
            yield (cells[i:j] & ((1 << BITS) - 1)).astype(np.int32), share[i:j]

    for raw, bounds, rows in segments(texts, BLANKS, piece_bytes):
        kinds, last = features(raw, bounds, rows, last)
        fresh = np.concatenate([(of * KINDS + kind) << BITS | ids.astype(np.int64) for kind, (ids, of) in enumerate(kinds)])
        fresh, n = np.unique(fresh, return_counts=True)
        cells, place = np.unique(np.concatenate([cells, fresh]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n]))
        # The last text of a run may go on in the next.
        stop = int(rows[-1])
        if stop > done:
            later = cells, counts
            cut = int(np.searchsorted(cells, stop * KINDS << BITS))
            cells, counts = cells[:cut], counts[:cut]
            yield from finished(stop)
            cells, counts, done = later[0][cut:], later[1][cut:], stop
    if len(texts):
        yield from finished(len(texts))


@dataclass(frozen=True)
class Model:
    """One number per feature and the bias: the difference of the two classes before the softmax."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
        sums, counts, last = np.zeros((KINDS, len(texts))), np.zeros((KINDS, len(texts))), None
        for raw, bounds, rows in segments(texts, BLANKS, piece_bytes):
            kinds, last = features(raw, bounds, rows, last)
            first, n = int(rows[0]), int(rows[-1] - rows[0]) + 1
            for kind, (ids, of) in enumerate(kinds):
                sums[kind, first : first + n] += np.bincount(of - first, weights=self.weights[ids], minlength=n)
                counts[kind, first : first + n] += np.bincount(of - first, minlength=n)
        total = self.bias + (sums / np.maximum(counts, 1)).sum(axis=0) / KINDS
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Softmax over averaged embeddings of merged features, one text per step."""
    y = np.array(labels, int)
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), bias)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    seen = np.full(1 << BITS, 1e-8, np.float32)
    output = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    shift = np.array([-bias / 2, bias / 2], np.float32)
    steps, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            ids, weight = texts[k]
            step = STEP * (1 - steps / total)
            steps += 1
            if not len(ids):
                continue
            hidden = weight @ table[ids]
            logits = output @ hidden + shift
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ output
            output -= 0.1 * step * np.outer(p, hidden)
            shift -= 0.1 * step * p
            pull = weight * float(np.sqrt((back * back).mean()))
            seen[ids] += pull * pull
            # Features of two kinds may share a bucket; then the later update of this text stands.
            table[ids] -= (step * weight / np.sqrt(seen[ids]))[:, None] * back
    return Model((table @ (output[1] - output[0])).astype(np.float32), float(shift[1] - shift[0]))


def learn(
    docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Fits on the whole texts of at most ``sample_rows`` labelled rows where ``may_learn`` (over ``key``) holds, chosen by a hash of the
    key among all of them. A key labelled twice counts by its highest label; repeated documents by one text."""
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & may_learn)
        .groupBy(key).agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64(key), key).limit(sample_rows).collect()
    )
    wanted = {r[0]: int(r[1]) for r in picked}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (ids, weights) in enumerate(merged(batch.column(1))):
                cells = [pa.array([ids.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *cells], names=["k", "ids", "weights"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["k"], r["ids"], r["weights"]) for batch in batches for r in batch.to_pylist()), key=lambda r: r[0])
        texts = [(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32)) for _, i, w in rows]
        model = train(texts, [wanted[k] for k, _, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    # The sample is bounded, so one task learns from its merged features; the driver only receives one number for each.
    sample = docs.where(F.col(key).isin(list(wanted))).groupBy(key).agg(F.max(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    features_of = sample.mapInArrow(merge, f"k {docs.schema[key].dataType.simpleString()}, ids binary, weights binary")
    found = features_of.repartition(1).mapInArrow(fit, "weights binary, bias double").first()
    return train([], []) if found is None else Model(np.frombuffer(bytes(found[0]), np.float32), found[1])


def scorer(spark: SparkSession, model: Model):
    """A column function: text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(batch), pa.float64())

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``key``, held_out, score, predicted. Rows whose fold is 0 are never learned from."""
    may_learn = fold(F.col(key)) != 0
    score = scorer(docs.sparkSession, learn(docs, labels, may_learn, key, text))
    held_out = F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out")
    scored = docs.select(key, held_out, score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are. ``labelled`` has doc_id, text."""
    score = scorer(docs.sparkSession, learn(labelled, labels, fold(F.col("doc_id")) != 0))
    return with_verdict(docs, score(F.col("text")), lambda s: s >= threshold)
