"""Components of the n-gram Jaccard join against all pairs, and the parts of its index against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import jaccard_join as jj
from corpuslens.llm.components import components


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute_force(rows):
    """component of each distinct key, by all pairs that share a shingle; rows of one key are linked."""
    sets = [(k, word_set(t)) for k, t in rows if k is not None]
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    seen = set()
    for group in holders.values():
        for x in range(len(group)):
            for y in range(x + 1, len(group)):
                seen.add((group[x], group[y]))
    for x, y in seen:
        (k, s), (j, t) = sets[x], sets[y]
        if 100 * len(s & t) >= 90 * len(s | t):
            a, b = find(k), find(j)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_force(rows)
    expected = sorted(((k, len(word_set(t)), want.get(k)) for k, t in rows), key=str)
    got = sorted((tuple(r) for r in jj.jaccard_components(docs).collect()), key=str)
    assert got == expected
    return got


def test_documents(documents):
    got = check(documents)
    assert any(k != c for k, _, c in got)


def test_odd_rows(odd, no_rows):
    check(odd)
    assert jj.jaccard_components(no_rows).collect() == []


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[i] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"add{rng.randrange(10**6)}")
    return words


def test_groups_of_near_copies(spark):
    """Chains and stars of near copies, sizes around class bounds, and pairs near the threshold."""
    rng = random.Random(11)
    texts = []
    for size in [3, 10, 11, 12, 19, 20, 21, 30, 45, 64, 100, 180, 400]:
        for _ in range(3):
            base = [f"w{rng.randrange(4000)}" for _ in range(size)]
            current = base
            for step in range(8):
                texts.append(" ".join(current))
                current = edited(rng, base if step % 2 else current, rng.randint(0, max(1, size // 40)))
    docs = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    check(docs)


def test_linked_sets_share_an_entry():
    rng = np.random.default_rng(3)
    for size in [*range(9, 40), 90, 101, 240, 1000, 3001]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, size // 9 + 1)
            add = size // 9 - drop
            b = np.unique(np.append(rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common):
                assert set(jj.entries(a)) & set(jj.entries(b))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300])
def test_rtree_finds_what_the_bound_allows(n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 12, (n, 64))
    v[n // 2 :] = v[: n - n // 2] + rng.integers(0, 2, (n - n // 2, 64))
    sizes, component = v.sum(axis=1), rng.integers(0, 5, n)
    got = {tuple(sorted(p)) for p in jj.rtree_pairs(sizes, v, component).tolist()}
    want = {
        (i, j) for i in range(n) for j in range(i + 1, n)
        if component[i] != component[j] and 190 * np.minimum(v[i], v[j]).sum() >= 90 * (sizes[i] + sizes[j])
    }
    assert got == want


def test_larger_groups_are_joined_in_blocks(spark, monkeypatch):
    """Many texts of one group that do not link with its first one, dealt out in several blocks."""
    monkeypatch.setattr(jj, "BLOCK", 16)
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(30):
            texts.append(" ".join(edited(rng, base, 2)))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))


def test_shingles_ignore_case_and_spacing():
    a, b, c = jj.shingles(pa.array(["The  cat\tSAT on", "the cat sat on", "the cat sat On mat"]))
    assert a.tolist() == b.tolist() and set(a) < set(c)


def test_components_of_a_long_path(spark):
    path = list(range(60))
    random.Random(2).shuffle(path)
    edges = [(a, b) for a, b in zip(path, path[1:])] + [(100, 101), (101, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in path} | {100: 100, 101: 100}


def test_one_of_each_group_stays(odd, no_rows):
    kept = jj.keep_first_of_groups(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, 9, None], key=str)
    assert jj.keep_first_of_groups(no_rows).collect() == []


def general_components(rows, words, percent):
    """Smallest linked key of each key, by all pairs."""
    sets = []
    for k, t in rows:
        w = t.lower().split()
        sets.append((k, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}))
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (k, s) in enumerate(sets):
        for j, t in sets[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90), (2, 60)])
def test_other_shingles_and_thresholds(spark, words, percent):
    random.seed(words)
    texts = []
    for n in [*range(1, 16), 20, 30, 45, 60, 90, 120, 200, 400]:
        base = [f"w{random.randrange(5000)}" for _ in range(n)]
        texts.append(base)
        for share in (0.01, 0.02, 0.03, 0.05, 0.1):
            copy = [f"e{random.randrange(5000)}" if random.random() < share else w for w in base]
            run, at = int(share * n), random.randrange(n)
            texts += [copy, base[:at] + [f"r{i}" for i in range(run)] + base[at + run :], base[: n - run]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts) if t]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs, words=words, percent=percent).collect()}
    assert got == general_components(rows, words, percent)


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 85, 90, 95])
def test_partners_are_in_the_own_class_or_the_one_below(percent):
    ends = jj.class_ends(percent)[:60].tolist()
    assert all(100 * (below - 1) < percent * above for below, above in zip(ends, ends[1:]))
    assert all(jj.slack(n, percent) == 0 for n in range(jj.least_size(percent))) and jj.slack(jj.least_size(percent), percent) >= 1


def test_near_copies_at_five_words_and_four_fifths(spark):
    """Two words in a hundred edited, or a run of 8 in 100: linked at 5 words and 0.8, not at 3 words and 0.9."""
    base = [f"word{i}" for i in range(500)]
    single = [f"edit{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    other = [f"other{i}" for i in range(500)]
    run = other[:200] + [f"new{i}" for i in range(40)] + other[240:]
    far = [f"far{i}" for i in range(500)]
    farther = [f"edit{i}" if i % 20 == 10 else w for i, w in enumerate(far)]
    rows = [(i, " ".join(t)) for i, t in enumerate([base, single, other, run, far, farther])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(set(brute_force(rows).values())) == 6
    assert sorted(r.doc_id for r in jj.keep_first_of_groups(docs, words=5, percent=80).collect()) == [0, 2, 4, 5]
    assert jj.keep_first_of_groups(docs).count() == 6


@pytest.mark.parametrize("ranges", [1, 4, 10])
def test_packed_entries_come_back(ranges):
    rng = np.random.default_rng(2)
    keys = [rng.integers(-(1 << 63), (1 << 63) - 1, size=int(n)) for n in rng.integers(0, 60, 40)]
    sets = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    keys[5], sets[5] = keys[4], sets[4]
    got = Counter()
    for of, data in jj.packed(keys, sets, ranges):
        entry, owner = jj.unpacked(of, data, ranges)
        assert (np.diff(entry.astype(object)) >= 0).all() and {int(e) >> (64 - ranges) for e in entry.tolist()} == {of}
        got.update(zip(entry.tolist(), owner.tolist()))
    want = Counter()
    for k, (key, owner) in enumerate(zip(keys, sets.tolist())):
        if k != 5:
            want.update((e % (1 << 64), owner) for e in key.tolist())
    assert got == want
    assert list(jj.packed([], sets[:0], ranges)) == []


def test_only_entries_of_different_sets_are_shared(monkeypatch):
    monkeypatch.setattr(jj, "MERGED", 7)
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(12):
        sets = rng.integers(0, 9, 6).astype(np.uint64)
        runs.append(([np.unique((int(s) * 31 + np.arange(8) * (1 + int(s) % 3)) % 90).astype(np.int64) << 40 for s in sets], sets))
    parts = [data for keys, sets in runs for _, data in jj.packed(keys, sets, 1)]
    holders = {}
    for keys, sets in runs:
        for key, owner in zip(keys, sets.tolist()):
            for e in key.tolist():
                holders.setdefault(e, set()).add(owner)
    got = {(int(e), int(s)) for entry, sets in jj.shared_entries(parts, 0, 1) for e, s in zip(entry, sets)}
    assert got == {(e, s) for e, owners in holders.items() if len(owners) > 1 for s in owners}


@pytest.mark.parametrize("percent", [80, 90])
def test_odd_sketches_lose_no_link_and_tell_most_others(percent):
    rng = np.random.default_rng(percent)
    passed = 0
    for size in [30, 146, 400, 700, 1500, 5000]:
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        for share in (0.5, 0.9, 1.0, 1.5):
            # Of the difference that a link allows, so much, in sets of two sizes.
            drop = int(share * 2 * size * (100 - percent) / (100 + percent) / 2)
            b = np.unique(np.append(a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            linked = 100 * common >= percent * (len(a) + len(b) - common)
            x, y = jj.odd_sketch(a), jj.odd_sketch(b)
            size_ = min(len(x), len(y))
            sketches = np.stack([jj.fold_sketch(x, size_), jj.fold_sketch(y, size_)])
            found, differ = jj.sketched_pairs(np.array([[0, 1]]), np.array([len(a), len(b)]), sketches, percent)
            assert len(found) or not linked
            assert all(differ <= len(a) + len(b) - 2 * common)
            passed += share == 1.5 and len(found)
    assert passed == 0


def test_sketches_of_different_length_are_folded():
    a = np.random.default_rng(1).integers(0, 2**63, 600, dtype=np.uint64)
    long, short = jj.odd_sketch(a), jj.odd_sketch(a[:500])
    assert len(long) == 2 * len(short)
    assert np.bitwise_count(jj.fold_sketch(long, len(short)) ^ short).sum() <= 100


def group_of(vectors, sketches, sizes, component):
    rows = len(sizes)
    kinds = ["entry", "i", "j", "own", "id", "c", "n"]
    zero = np.zeros(rows, np.int64)
    columns = [zero + 7, zero, zero, zero, np.arange(rows), component, sizes]
    arrays = [pa.array(np.asarray(c, np.int64)) for c in columns] + [pa.array([jj.stored(v) for v in vectors]), pa.array([s.tobytes() for s in sketches])]
    return pa.RecordBatch.from_arrays(arrays, names=[*kinds, "v", "o"])


def test_an_entry_gives_rows_by_its_sets_not_by_their_pairs():
    """Near copies that all may link with each other, and ones that are a little too far apart."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 146, dtype=np.uint64)

    def near(drop):
        return np.append(base[rng.permutation(146)[drop:]], rng.integers(0, 2**63, drop, dtype=np.uint64))

    for drop, most in ((3, 299), (20, 299)):
        sets = [near(drop) for _ in range(300)]
        group = group_of([jj.count_vector(s) for s in sets], [jj.odd_sketch(s) for s in sets], [146] * 300, np.arange(300))
        rows = pa.Table.from_batches(list(jj._join_groups(80, False)(iter([group])))).to_pylist()
        pairs = [r for r in rows if r["more"] is None]
        assert len(pairs) <= most
        assert [r["more"] for r in rows if r["more"] is not None] == ([7] if drop == 3 else [])
        every = pa.Table.from_batches(list(jj._join_groups(80, True)(iter([group])))).num_rows
        assert every == (300 * 299 // 2 if drop == 3 else len(pairs))


def test_what_a_forest_leaves_out_is_searched_again(spark):
    """The likest pairs by sketch are no links here (the sketches are blind), so the forest alone would lose the one link."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(12):
        own = list(words)
        for at in rng.permutation(400)[:14]:
            own[at] = f"x{k}-{at}"
        texts.append(" ".join(own))
    texts.append(texts[-1].replace("w200", "y").replace("w7 ", "z "))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def blind(pairs, n, sketches, percent=jj.PERCENT):
        return pairs, np.zeros(len(pairs), np.int64)

    sets = [set(next(jj.shingles(pa.array([t]))).tolist()) for t in texts]
    links = [(i, j) for i in range(13) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert links == [(12, 11)]
    real, jj.sketched_pairs = jj.sketched_pairs, blind
    try:
        got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs).collect()}
    finally:
        jj.sketched_pairs = real
    assert got == {i: 11 if i == 12 else i for i in range(13)}
