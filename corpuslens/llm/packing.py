"""Best-fit packing of documents into sequences by patterns fitted with non-negative least squares.

Lengths are whole numbers up to the sequence length, so the corpus is a histogram of bounded size. Patterns of two
to four lengths that fill a sequence are enumerated and their repeat counts fitted to the histogram by non-negative
least squares. At most as many patterns as there are lengths stay in the fit; their counts are fitted again, rounded as
far as the histogram allows, and taken out of it. What is left is fitted anew until no pattern places a piece; the
residue is packed best fit. All of this works on counts per length: its cost depends on the sequence length, not on the
corpus.

The plan is then dealt out: pieces are numbered within their length, and every slot of the plan owns a run of
those numbers. A document longer than a sequence is cut into full pieces; the first may be shorter.

NULL and empty texts are one piece of one id (the separator). Repeated rows are packed as often as they occur. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import BATCH_BYTES, save, slabs
from corpuslens.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
#: Distinct pieces of text that a Python worker remembers with their ids: a fourth of the other users', as a
#: worker that keeps 800000 takes some 100 MB more.
CACHE_PIECES = 200_000
#: Bounds the enumeration of patterns and the rounds of the fit; neither depends on the corpus.
MAX_PATTERNS = 30_000
ROUNDS = 60
#: Times that the remainder is fitted anew, at most.
REFITS = 60


def enumerate_patterns(present: np.ndarray, capacity: int, limit: int = MAX_PATTERNS) -> np.ndarray:
    """Patterns of two, three and four present lengths that sum to ``capacity``, largest first, 0 where there is none.

    Every length gets its full pair and, spread evenly over the second length, triples and quadruples.
    """
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[0] = False
    out = []
    a = present[(present < capacity)][::-1]
    b = capacity - a
    pair = (b <= a) & has[b]
    out.append(np.stack([a[pair], b[pair], np.zeros_like(a[pair]), np.zeros_like(a[pair])], 1))
    spread = max(1, limit // (2 * max(len(a), 1)))
    for parts in (3, 4):
        for first in a:
            room = capacity - first
            if parts == 4:
                room -= first // 3
            second = present[(present < room) & (present <= first)]
            if not len(second):
                continue
            second = second[np.linspace(0, len(second) - 1, min(spread, len(second))).astype(int)]
            third = room - second
            fourth = np.full(len(second), capacity - first - room)
            ok = has[third] & (third <= first) & ((fourth == 0) | has[fourth])
            out.append(np.stack([np.full(ok.sum(), first), second[ok], third[ok], fourth[ok]], 1))
    patterns = -np.sort(-np.concatenate(out), axis=1)
    return np.unique(patterns, axis=0)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' lengths close to the histogram, by multiplicative
    updates x <- x * (A'h) / (A'Ax), which never leave the non-negative range and never raise the squared error."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    cells, owner = patterns[used], np.nonzero(used)[0]
    target = np.bincount(owner, weights=histogram[cells], minlength=len(patterns))
    x = np.full(len(patterns), histogram.sum() / max(used.sum(), 1))
    for _ in range(rounds):
        made = np.bincount(cells, weights=x[owner], minlength=len(histogram))
        x *= target / np.maximum(np.bincount(owner, weights=made[cells], minlength=len(patterns)), 1e-12)
    return x


def fit_patterns(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that patterns fill; their pieces are taken out of ``left``."""
    plan: list[tuple[tuple[int, ...], int]] = []
    for _ in range(REFITS):
        present = np.flatnonzero(left)
        patterns = enumerate_patterns(present, capacity) if len(present) else np.zeros((0, 4), np.int64)
        if not len(patterns):
            break
        # The least squares need no more patterns than lengths: the largest counts stay and share what is fitted.
        patterns = patterns[np.argsort(-fit(patterns, left.astype(float)), kind="stable")[: len(present)]]
        counts = fit(patterns, left.astype(float), 2 * ROUNDS)
        wanted, budget, placed = np.rint(counts).astype(np.int64), int(np.ceil(counts.sum())), 0
        # Rounded to the nearest, small counts up to one, while the sum of all counts and the histogram allow.
        for k in np.argsort(-counts, kind="stable"):
            lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = min(max(1, int(wanted[k])), int((left[lengths] // times).min()), budget - placed)
            if n > 0:
                left[lengths] -= n * times
                plan.append((tuple(int(v) for v in patterns[k] if v), n))
                placed += n
        if not placed:
            break
    return plan


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, how many such sequences). ``histogram[n]`` counts the pieces of length n."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    return plan + fit_patterns(left, capacity) + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: equal pieces go to equal sequences together."""
    open_at: dict[int, list[list]] = defaultdict(list)
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int, space: int) -> None:
        if not open_at[space]:
            insort(spaces, space)
        open_at[space].append([lengths, n])

    for length in map(int, np.flatnonzero(left)[::-1]):
        n = int(left[length])
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fits = capacity // length
                if full := n // fits:
                    put((length,) * fits, full, capacity - fits * length)
                if rest := n % fits:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            space = spaces[at]
            lengths, there = open_at[space].pop()
            if not open_at[space]:
                spaces.pop(at)
            # As many of this length as fit into each of the sequences.
            fits = min(space // length, n)
            take = min(there, n // fits)
            if take < there:
                put(lengths, there - take, space)
            put(lengths + (length,) * fits, take, space - fits * length)
            n -= take * fits
    return [(lengths, n) for group in open_at.values() for lengths, n in group]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """For each slot of the plan, in order of length: length, first number, first sequence, place in the sequence."""
    rows, taken, sequence = [], defaultdict(int), 0
    for lengths, n in plan:
        place = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, place))
            taken[length] += n
            place += length
        sequence += n
    cells = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return cells[:, 0], cells[:, 1], cells[:, 2], cells[:, 3]


def cut(docs: DataFrame, key: str, text: str, capacity: int, separator: int, tokenizer: str | None) -> DataFrame:
    """Pieces of all documents with a number within (task, length), written once."""
    path = tokenizer or default_tokenizer()
    names = [key, "piece", "start", "length", "ids_crc32", "part", "number"]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path, CACHE_PIECES), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            at = 0
            for slab in slabs(batch.column(1)):
                ids, counts = coder.encode(slab)
                ids = np.insert(ids, np.cumsum(counts), separator).astype("<u4")
                ends = np.cumsum(counts + 1)
                rows: list[list] = [[] for _ in range(7)]
                for k, (first, last) in enumerate(zip(ends - counts - 1, ends)):
                    n = int(last - first)
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        length = b - a
                        crc = zlib.crc32(ids[first + a : first + b].tobytes())
                        for column, value in zip(rows, (at + k, piece, a, length, crc, part, seen[length])):
                            column.append(value)
                        seen[length] += 1
                keys = batch.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(v, t) for v, t in zip(rows[1:], kinds[1:])]], names=names)
                at += len(slab)

    kind = docs.select(key).dtypes[0][1]
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, number bigint"
    return save(docs.select(key, text).mapInArrow(pieces, schema), "pieces", BATCH_BYTES)


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = 0, tokenizer: str | None = None
) -> DataFrame:
    """Per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut(docs, key, text, capacity, separator, tokenizer)
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    shared = spark.sparkContext.broadcast(slots(plan_packing(histogram, capacity)))

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        of, first, sequence, offset = shared.value
        length, number = length.to_numpy(), number.to_numpy()
        at = np.searchsorted(of << 40 | first, length << 40 | number, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    numbered = pieces.join(shifts, ["length", "part"]).withColumn("_at", place("length", F.col("number") + F.col("_shift")))
    return numbered.select(key, "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
