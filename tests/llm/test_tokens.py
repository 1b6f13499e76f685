"""Token encoding, token files and packing against the tokenizer itself and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import jaccard_join, packing, token_files
from corpuslens.llm.common import BATCH_BYTES, save
from corpuslens.llm.tokens import Encoder, default_tokenizer, encoder


def plain(text):
    coder = encoder(default_tokenizer()).tokenizer
    return coder.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_tokenizers_ids():
    random.seed(5)
    signs = [*"abé \n\t  '.,!19|ß日", "　", " ", "\u0085", "\x1c", "'s", "<|endoftext|>", "  ", "\r\n", "É!!", "×"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(3000)] + ["", None]
    ids, counts = encoder(default_tokenizer()).encode(pa.array(texts))
    at = np.append(0, np.cumsum(counts))
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == plain(text)


def test_added_tokens_as_a_freshly_loaded_tokenizer_gives_them(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_tokenizer())
    texts = ["a<|endoftext|>b", None, "plain text", "<|endoftext|>", "x <|endoftext|>\n\n<|endoftext|> y", "", "<|endoftext|", "the end"]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    ids, counts = encoder(default_tokenizer()).encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_files.token_files_roundtrip(docs).select("doc_id", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == [(i, len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for i, w in enumerate(want)]
    pieces = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id, r.length) for r in pieces) == [(i, len(w) + 1) for i, w in enumerate(want)]


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=200))
@settings(max_examples=50, deadline=None)
def test_variable_length_code_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    got = token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert got.tolist() == values


def expected(rows, end):
    """Per row in key order: start, number and crc32 of the ids."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*plain(text), end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_token_files(request, which):
    docs = request.getfixturevalue(which)
    got = token_files.token_files_roundtrip(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, 2)


def test_several_files_in_a_part(documents):
    folder = token_files.scratch_path(documents.sparkSession, "files")
    manifest = token_files.write_token_files(documents, folder=folder, file_ids=20_000)
    assert manifest.count() > 4
    got = token_files.read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected([tuple(r) for r in documents.select("doc_id", "text").collect()], 2)


def test_no_rows(no_rows):
    assert token_files.token_files_roundtrip(no_rows).collect() == []
    assert packing.pack_documents(no_rows).collect() == []


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    got = packing.pack_documents(docs).collect()
    want = []
    for key, text in docs.select("doc_id", "text").collect():
        ids = np.array([*plain(text), 0], "<u4")
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(key, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(w[3] for w in want) // 2048)
    assert len(sequences) <= least * 1.03 + 2


@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 500)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_packs_every_piece_once(cells):
    histogram = np.zeros(65, np.int64)
    for length, n in cells:
        histogram[length] += n
    plan = packing.plan_packing(histogram, 64)
    packed = np.zeros(65, np.int64)
    for lengths, n in plan:
        assert sum(lengths) <= 64 and n > 0
        np.add.at(packed, list(lengths), n)
    assert (packed == histogram).all()
    total = int((histogram * np.arange(65)).sum())
    # Best fit leaves at most one sequence that is not over half full.
    assert sum(n for _, n in plan) <= 2 * -(-total // 64) + 1


def test_fit_explains_the_histogram():
    histogram = np.zeros(101)
    histogram[[70, 30, 60, 40, 50, 25]] = [500, 500, 300, 300, 200, 400]
    patterns = packing.enumerate_patterns(np.flatnonzero(histogram), 100)
    counts = packing.fit(patterns, histogram)
    made = sum(np.bincount(p[p > 0], minlength=101) * c for p, c in zip(patterns, counts))
    assert (counts >= 0).all() and np.abs(made - histogram).sum() < 0.02 * histogram.sum()


def test_patterns_place_nearly_all_pieces():
    """On the lengths of a corpus: over nine tenths of the short pieces, in no more sequences than best fit alone needs."""
    rng = np.random.default_rng(0)
    lengths = np.minimum(np.exp(rng.normal(6.2, 1.0, 8000)).astype(int) + 1, 2047)
    histogram = np.bincount(lengths, minlength=2049)
    left = histogram.copy()
    plan = packing.fit_patterns(left, 2048)
    made = np.zeros(2049, int)
    for pattern, n in plan:
        assert sum(pattern) == 2048 and 2 <= len(pattern) <= 4
        np.add.at(made, list(pattern), n)
    assert np.array_equal(made + left, histogram) and left.sum() < 0.1 * histogram.sum()
    whole = packing.plan_packing(histogram)
    alone = sum(n for _, n in packing.best_fit(histogram.copy(), 2048))
    assert sum(n for _, n in whole) <= max(alone, -(-int(lengths.sum()) // 2048) + 1)
    assert packing.plan_packing(np.zeros(2049, int)) == []
    assert packing.fit_patterns(np.bincount([2000, 2001], minlength=2049), 2048) == []


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    """12 MB in one partition used to be one batch of 3000 rows, held by the executor and by its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    rows = save(docs.mapInArrow(sizes, "n bigint, size bigint"), "sizes", BATCH_BYTES).collect()
    assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(name) == before
    spark.conf.set(name, "1000000")
    try:
        rows = save(docs.mapInArrow(sizes, "n bigint, size bigint"), "sizes", BATCH_BYTES).collect()
        assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) <= 1_100_000
    finally:
        spark.conf.set(name, before)


def test_python_tasks_on_texts_receive_bounded_batches(spark, monkeypatch):
    given_, texts = {}, [" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def noted(df, label, batch_bytes=None):
        given_[label] = batch_bytes
        return save(df, label, batch_bytes)

    monkeypatch.setattr(packing, "save", noted)
    monkeypatch.setattr(jaccard_join, "save", noted)
    assert packing.pack_documents(docs).count() == 4
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    python = {"pieces", "signatures", "members", "bound-v", "star", "links", "hidden"}
    assert {label for label, size in given_.items() if size == BATCH_BYTES} == python


def test_an_encoder_keeps_the_pieces_it_is_told_to():
    texts = pa.array([" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}" for i in range(a, a + 40)) for a in range(0, 400, 40)])
    small, want = Encoder(default_tokenizer(), 100), encoder(default_tokenizer()).encode(texts)
    got = []
    for k in range(len(texts)):
        got.append(small.encode(texts.slice(k, 1))[0])
        assert len(small.known) <= 100
    assert np.concatenate(got).tolist() == want[0].tolist()
