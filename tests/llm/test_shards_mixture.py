"""Shards: exact counts, slots and few cut groups. Mixture: exponents, budgets and whole passes."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import mixing as mx
from corpuslens.llm import sharding as sh
from corpuslens.llm.common import words


def check_shards(got, shards):
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(documents):
    got = sh.shard_documents(documents).collect()
    texts = dict(map(tuple, documents.select("doc_id", "text").collect()))
    assert sorted(r.doc_id for r in got) == sorted(texts)
    check_shards(got, 24)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    groups = defaultdict(set)
    for r in got:
        groups[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) - 1 for s in groups.values()) == 0


def test_a_group_larger_than_its_quota(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 4 < 2 else f"text {i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sh.shard_documents(docs, shards=8).collect()
    check_shards(got, 8)
    texts = dict(rows)
    groups = defaultdict(Counter)
    for r in got:
        groups[texts[r.doc_id]][r.shard] += 1
    # 400 rows cannot stand in fewer than three shards of 150; by hash they would stand in all eight alike.
    assert sum(n for _, n in groups["hot"].most_common(3)) >= 0.8 * 400
    pairs = [len(s) for t, s in groups.items() if sum(s.values()) == 2]
    assert sum(n == 1 for n in pairs) >= 0.8 * len(pairs)


def test_a_group_of_a_third_of_the_rows_stands_in_as_few_shards_as_hold_it(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 15 == 1 else f"pair {i // 4}" if i % 4 < 2 else f"text {i}") for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sh.shard_documents(docs).collect()
    check_shards(got, 24)
    texts, groups = dict(rows), defaultdict(Counter)
    for r in got:
        groups[texts[r.doc_id]][r.shard] += 1
    assert sum(groups["hot"].values()) == 1600 and len(groups["hot"]) == 8
    assert sum(groups["warm"].values()) == 320 and len(groups["warm"]) == 2
    assert all(len(s) == 1 for t, s in groups.items() if sum(s.values()) == 2)


@pytest.mark.parametrize("sizes", [[70, 70, 70], [150, 60, 60, 30], [300], [1], []])
def test_large_groups_are_placed_once_within_the_quotas(sizes):
    quotas = [101, 100, 100]
    pieces, placed = sh.plan_large(sizes, quotas)
    used = Counter()
    for size, spans in zip(sizes, pieces):
        ends = [*[a for a, _, _ in spans[1:]], size]
        for (a, shard, slot), z in zip(spans, ends):
            assert z > a and slot == used[shard]
            used[shard] += z - a
    assert [used[s] for s in range(3)] == placed and all(p <= q for p, q in zip(placed, quotas))


def test_all_rows_linked(spark):
    docs = spark.createDataFrame([(i, f"t{i % 10}") for i in range(200)], "doc_id bigint, text string")
    check_shards(sh.shard_documents(docs, shards=8).collect(), 8)


def test_odd_shards(odd, no_rows):
    got = sh.shard_documents(odd).collect()
    check_shards(got, 24)
    assert len(got) == 11 and {(r.size, r.text_crc32) for r in got if r.doc_id in (2, 3)} == {(8, 0)}
    assert sh.shard_documents(no_rows).collect() == []


def tokens(text):
    return len((text or "").split(" ")) + 1


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), s) for i, s in enumerate(["a"] * 600 + ["b"] * 200 + [None] * 60 + ["c"] * 20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


@pytest.mark.parametrize("repeats", [1.0, 1.5, 2.0, 5.0])
def test_repeats_and_whole_passes(corpus, repeats):
    got = mx.mix_sources(corpus, max_repeats=repeats, block_tokens=200).collect()
    rows = {r.doc_id: r for r in corpus.collect()}
    assert {r.doc_id for r in got} == set(rows)  # no document is dropped by default
    spent, whole = Counter(), Counter()
    for r in got:
        spent[r.source] += tokens(rows[r.doc_id].text)
    for r in rows.values():
        whole[r.source] += tokens(r.text)
    for s in whole:
        assert spent[s] <= repeats * whole[s] * 1.0001
        numbers = Counter(r["__mix"].number for r in got if r.source == s)
        assert all(numbers[i] == sum(r.source == s for r in rows.values()) for i in range(max(numbers)))
    least = min(whole, key=whole.get)
    assert spent[least] >= repeats * whole[least] * 0.95 - 12


def test_entropy(corpus):
    for share in (0.7, 0.9, 1.0):
        got = mx.mix_sources(corpus, entropy_share=share).collect()
        weight = {r.source: r["__mix"].weight for r in got}
        assert sum(weight.values()) == pytest.approx(1)
        assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(share * math.log(4), abs=1e-4)


def test_a_given_budget_is_kept_block_by_block(corpus):
    for budget in (300, 2000, 20_000):
        got = mx.mix_sources(corpus, max_repeats=None, budget_tokens=budget, block_tokens=200).collect()
        spent = Counter()
        for r in got:
            spent[r.source] += r["__mix"].tokens
        for s, n in spent.items():
            granted = next(r["__mix"].weight for r in got if r.source == s) * budget
            assert granted - 13 <= n <= granted + 1
        # In the partial pass, only the last block of the order is cut.
        partial = defaultdict(set)
        for r in got:
            partial[r.source, r["__mix"].number].add(r["__mix"].block_key)
        assert all(partial.values())


def test_seeds_give_other_orders(corpus):
    one, two = (mx.mix_sources(corpus, max_repeats=1.5, seed=s).select("doc_id", "__mix.number", "__mix.row_key").collect() for s in (1, 2))
    assert {r.row_key for r in one} != {r.row_key for r in two}


def test_odd_mixture(odd, no_rows):
    got = mx.mix_sources(odd)
    assert got.columns == [*odd.columns, "__mix"]
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in odd.collect()}
    assert mx.mix_sources(no_rows).collect() == []


@pytest.mark.parametrize("block_tokens", [500, 1 << 18])
def test_mixture_against_replayed_passes(spark, documents, block_tokens):
    """Whole passes and the partial one, replayed block by block and row by row in plain Python."""
    seed, repeats = mx.SEED, 2.7
    got = mx.mix_sources(documents, max_repeats=repeats, block_tokens=block_tokens).select("doc_id", "__mix.number").collect()
    name, key = mx.source_key(F.col("source")), F.col("doc_id").cast("string")
    n = (F.size(words(F.col("text"))) + 1).cast("bigint")
    rows = documents.select(name.alias("_s"), key.alias("_k"), n.alias("_n"))
    plan = mx.plan_mixture(rows, repeats, block_tokens=block_tokens)
    block = mx.block_of(F.col("_k"), F.col("blocks"), seed)
    keyed = rows.join(plan, "_s").select(
        "_s", "_k", "_n", "passes", "rest", mx.block_key(F.col("passes"), F.col("_s"), block, seed).alias("h"), mx.row_key(F.col("passes"), F.col("_k"), seed).alias("r"))
    sources = defaultdict(list)
    for row in keyed.collect():
        sources[row["_s"]].append(row)
    want = Counter()
    for held in sources.values():
        for row in held:
            want.update((int(row["_k"]), number) for number in range(row["passes"]))
        left, blocks = held[0]["rest"], defaultdict(list)
        for row in held:
            blocks[row["h"]].append(row)
        for h in sorted(blocks):
            size = sum(row["_n"] for row in blocks[h])
            if size <= left:
                want.update((int(row["_k"]), row["passes"]) for row in blocks[h])
                left -= size
                continue
            for row in sorted(blocks[h], key=lambda row: row["r"]):
                if row["_n"] > left:
                    break
                want[int(row["_k"]), row["passes"]] += 1
                left -= row["_n"]
            break
    assert Counter((r.doc_id, r.number) for r in got) == want
    assert len(sources) > 3 and any(number > 0 for _, number in want)
