"""The prefix trie against a rebuilt one in plain Python: given rows, odd rows, long and frequent conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from corpuslens.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_force(rows):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, role, text))
    # Ties of turn hold equal turns only in these fixtures.
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    for node, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members) - 1) * words
    return sorted(
        (min(m), len(node), min(nodes[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in nodes.items()
    )


def compare(frame):
    got = sorted(map(tuple, pt.prefix_trie(frame).collect()), key=str)
    assert got == sorted(brute_force([r.asDict() for r in frame.collect()]), key=str)
    return got


def test_given_rows(spark):
    assert len(compare(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))) > 100


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "same first"), (1, 1, None, "b c"), (1, None, "system", None), (2, 0, "user", "same first"), (2, 1, None, "b c"),
        (2, None, "system", ""), (3, 5, "user", "x"), (3, 5, "user", "x"), (None, 0, "user", "lost"), (20, 0, "us", "era"), (21, 0, "user", "a"),
        (22, 0, "", "user"), (40, 1, "user", " \t\n"), (41, 1, "user", ""), (42, 0, "", ""), (-3, 0, "user", "minus"), (-20, 0, "user", "base"),
        (-25, 0, "user", "base"), (60, 0, "user", "long " * 20000), (61, 0, "user", "long " * 20000),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS n", "3 AS depth", "4 AS conv", "5 AS tokens", "6 AS _at")
    compare(frame)


def test_no_rows(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("band", [2, 3])
def test_bands_and_long_conversations(spark, monkeypatch, band):
    """Depths of several bands of bands, branches in the middle of them, and ends shared by many."""
    monkeypatch.setattr(pt, "BAND", band)
    monkeypatch.setattr(pt, "CHUNK_IDS", 3)
    rows = []
    for c in range(1, 60):
        length = (c * 7) % 40
        for t in range(length):
            rows.append((c, t, "user" if t % 2 else "bot", f"t {t}" if t < 30 - c % 5 or c % 3 == 0 else f"own {c % 4} {t}"))
        if not length:
            rows.append((c, 0, "user", "t 0"))
    compare(spark.createDataFrame(rows, SCHEMA))


def test_many_equal_ends(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 3000) for t in range(2)]
    got = compare(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert max(r[3] for r in got) == 3000
