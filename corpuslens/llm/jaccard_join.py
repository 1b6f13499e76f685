"""N-gram Jaccard join over a count-vector index.

A document is the set of its word n-grams. Two documents link when 100 * |intersection| >= percent * |union|; unless
a caller says otherwise, n is 3 and percent is 90. Linked sets, the smaller of size a, differ in at most
a * (100 - percent) // percent shingles in all (``slack``; a // 9 at 90). Shingles are hashed into groups, more
groups than that number for a document's size class, so linked documents agree fully in at least one group: its
count is the same, and so is the sum of its shingles. The index holds every document under (group, count, sum).

0. Entries travel packed: those of a run of texts and of one range of entries are one row of sorted, compressed differences.
   A task takes a range, finds the entries that two different sets share, and gives only those on; it holds distinct
   entries, not the documents behind one.
1. Equal sets become one representative, so copies cost nothing further.
2. Under each index entry, every document is compared with the entry's smallest one: a star, never all pairs. The
   overlap is bounded by the sum of coordinate minima of two group-count vectors before texts are compared.
3. Links found so far give components. Only entries whose documents still lie in several components can hide
   another link; of entries with the same documents one is enough. There an R-tree over the count vectors (packed
   pages with bounding boxes) is joined with itself: page pairs are skipped when the summed minima of their upper
   corners are too small, or when all their points already share a component. Pairs of points meet with odd sketches.
   Of what is left an entry gives a forest over its components, the likest pairs first, so its rows follow its
   documents and not their pairs; they are verified on whole texts. Entries that had more pairs are searched once
   more, in full, with the components that the forest's links gave.

Count vectors have a coordinate for about every sixteen shingles, in powers of two; vectors of different length are
folded to the shorter one. They reject nearly all pairs. An odd sketch tells for each of two slots or more a shingle whether
an odd number of shingles fall there: slots in which two sketches differ are at most the shingles in which the sets
differ, and seldom many less. Only what passes both meets with whole texts.

An R-tree over the whole corpus could not do this alone: at this threshold, boxes of unrelated texts of one size
overlap in every coordinate, so nearly all page pairs would survive. The equal group is what routes to a page.

NULL, empty and blank texts have no shingle and link with nothing. Rows without a key have component NULL. Rows that
share a key count as linked. Repeated rows are equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpuslens.llm.common import BATCH_BYTES, save, slabs, utf8
from corpuslens.llm.components import components

#: Words of a shingle, and the least similarity of linked sets in hundredths.
N, PERCENT = 3, 90
#: Shingles for each coordinate of a count vector, and the fewest coordinates.
PER_COORDINATE, LEAST_COORDINATES = 16, 16
#: Slots of an odd sketch for each shingle, and the fewest slots.
PER_SHINGLE, LEAST_SLOTS = 2, 1024
#: A size class spans the largest ratio of linked sets' sizes times this; a document also stands in the class below if
#: partners may be there. The spare keeps partners out of the class below that one.
CLASS_SPARE = 1.08
#: Groups beyond the slack, so that empty groups need not be indexed for nearly all documents.
SPARE = 2
#: Ids up to this number (8 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Documents of one index entry that one task takes; larger entries are dealt out as pairs of such blocks.
BLOCK = 2048
PAGE = 16

#: Entries of a row that the number of ranges is planned with, entries of one range, and the fewest ranges (as powers of 2).
ENTRIES_PER_ROW, RANGE_ENTRIES, LEAST_RANGES = 256, 4 << 20, 6
#: Entries that a task merges at a time.
MERGED = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, words: int = N) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its lower-cased word n-grams; a shorter text is one shingle."""
    data, offsets = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1] | False
    starts_of_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_text] = ~space[starts_of_text]
    starts = np.flatnonzero(first)
    if not len(starts):
        for _ in range(len(texts)):
            yield np.zeros(0, np.uint64)
        return
    run = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(run, 0)]
    inside = ~space & (run >= 0)
    power = np.cumprod(np.full(int(place[inside].max()) + 1, _POWER), dtype=np.uint64)
    term = np.zeros(len(data), np.uint64)
    term[inside] = _BYTE[data[inside]] * power[place[inside]]
    word = mix(np.add.reduceat(term, starts))
    bounds = np.searchsorted(starts, offsets, "left")
    k = np.uint64(0xD6E8FEB86659FD93)
    gram = word
    for i in range(1, words):
        gram = mix(gram[:-1] * k + word[i:]) if len(gram) > 1 else gram[:0]
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            yield np.unique(gram[a : b - words + 1])
        else:
            whole = word[a : min(a + 1, b)]
            for i in range(a + 1, b):
                whole = (mix(whole) if i > a + 1 else whole) * k + word[i : i + 1]
            yield mix(whole + np.uint64(b - a))


def slack(size: int, percent: int = PERCENT) -> int:
    """The most shingles in which a linked pair can differ, given the smaller set's size."""
    return size * (100 - percent) // percent


def least_size(percent: int = PERCENT) -> int:
    """Smaller sets only link when equal."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 40


@cache
def class_ends(percent: int = PERCENT) -> np.ndarray:
    """Lower ends of the size classes."""
    ends = [least_size(percent)]
    while ends[-1] <= 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * (100 / percent * CLASS_SPARE))))
    return np.array(ends)


def entries(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index entries of one set: for its size class, and the one below when that may hold partners."""
    n = len(grams)
    ends = class_ends(percent)
    own = int(np.searchsorted(ends, n, "right")) - 1
    out = []
    for level in (own, own - 1):
        if level < 0:
            continue
        top = int(ends[level + 1]) - 1
        if level < own and percent * n > 100 * top:
            continue
        groups = slack(top, percent) + 1
        f = slack(min(n, top), percent)
        used = min(groups, f + 1 + SPARE)
        group = ((grams >> np.uint64(11)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=groups)
        total = np.zeros(groups, np.uint64)
        full = np.flatnonzero(count)
        total[full] = np.add.reduceat(mix(grams[order] + np.uint64(0xA5A5)), (np.cumsum(count) - count)[full])
        key = mix(total + np.arange(groups, dtype=np.uint64) * _POWER + mix(count.astype(np.uint64) + np.uint64(level << 40)))
        keep = count[:used] > 0
        # All groups on which a linked pair agrees can only be empty if there are this many empty ones.
        if used - int(keep.sum()) >= used - f:
            keep[:] = True
        out.append(key[:used][keep])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Shingles per coordinate; the number of coordinates is a power of two that follows the set's size."""
    size = LEAST_COORDINATES
    while size * PER_COORDINATE < len(grams):
        size *= 2
    return np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size).astype("<u4")


def fold(vector: np.ndarray, size: int) -> np.ndarray:
    return vector if len(vector) == size else vector.reshape(-1, size).sum(axis=0, dtype=vector.dtype)


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each slot, packed: whether an odd number of shingles fall there. The number of slots is a power of two that
    follows the set's size."""
    size = LEAST_SLOTS
    while size < PER_SHINGLE * len(grams):
        size *= 2
    slots = ((grams >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=size) & 1).astype(np.uint8))


def fold_sketch(sketch: np.ndarray, size: int) -> np.ndarray:
    return sketch if len(sketch) == size else np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def packed(keys: list[np.ndarray], sets: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """The entries of some sets, by range: (range, packed). ``ranges`` is the number of leading bits of an entry that tell
    its range. Sets with the same hash in ``sets`` have the same entries and are packed once."""
    _, first = np.unique(sets, return_index=True)
    sets, keys = sets[first], [keys[i] for i in first]
    entry = np.concatenate(keys).view(np.uint64) if keys else np.zeros(0, np.uint64)
    code = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(entry)
    entry, code = entry[order], code[order]
    of = (entry >> np.uint64(64 - ranges)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.append(True, np.diff(of) != 0)), len(of)) if len(of) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1], edges[1:]):
        used, codes = np.unique(code[i:j], return_inverse=True)
        steps = np.diff(entry[i:j], prepend=np.uint64(int(of[i]) << (64 - ranges)))
        # Bytes of the same place lie together: those of large places are all zero.
        planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
        kind = "<u2" if len(used) < 1 << 16 else "<u4"
        body = sets[used].astype("<u8").tobytes() + codes.astype(kind).tobytes() + planes
        yield int(of[i]), zstandard.compress(np.array([j - i, len(used)], "<u4").tobytes() + body, 1)


def unpacked(of: int, data: bytes, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries and the hash of the set behind each."""
    raw = zstandard.decompress(data)
    n, used = np.frombuffer(raw, "<u4", 2).tolist()
    kind = np.dtype("<u2" if used < 1 << 16 else "<u4")
    sets = np.frombuffer(raw, "<u8", used, 8)
    codes = np.frombuffer(raw, kind, n, 8 + 8 * used)
    planes = np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * used + n * kind.itemsize)
    steps = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(of << (64 - ranges)), sets[codes]


def shared_entries(parts: list[bytes], of: int, ranges: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, set) of the entries of one range that different sets stand under. Distinct entries are held, each with its
    first set; the rows are read twice, so that an entry of very many sets takes no more memory than any other."""

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for part in parts:
            held.append(unpacked(of, part, ranges))
            size += len(held[-1][0])
            if size >= MERGED:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held))

    entry, first, several = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    for more, sets in chunks():
        entry, first, several = np.concatenate([entry, more]), np.concatenate([first, sets]), np.append(several, np.zeros(len(more), bool))
        order = np.argsort(entry, kind="stable")
        entry, first, several = entry[order], first[order], several[order]
        starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        other = first != np.repeat(first[starts], np.diff(np.append(starts, len(entry))))
        entry, first, several = entry[starts], first[starts], np.logical_or.reduceat(several | other, starts)
    wanted = entry[several]
    if len(wanted):
        for more, sets in chunks():
            at = np.minimum(np.searchsorted(wanted, more), len(wanted) - 1)
            kept = wanted[at] == more
            yield more[kept], sets[kept]


def stored(vector: np.ndarray) -> bytes:
    """Counts in one byte each if all fit, else in four; the first byte tells."""
    small = not len(vector) or int(vector.max()) < 256
    return (b"\x01" if small else b"\x04") + vector.astype(np.uint8 if small else "<u4").tobytes()


def loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else "<u4", offset=1).astype(np.uint32)


def signatures(docs: DataFrame, key: str, text: str, words: int = N, percent: int = PERCENT, ranges: int = LEAST_RANGES) -> DataFrame:
    """Written once, two kinds of rows. Per row of ``docs``: id, n (set size), two hashes of the set, one of both, count
    vector, odd sketch. And the packed index entries of the rows with a key: grp, data."""

    least = least_size(percent)
    kinds = {"id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "s": pa.int64(), "v": pa.binary(), "o": pa.binary(), "grp": pa.int64(), "data": pa.binary()}

    def batch(size: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], names=list(kinds))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = 0
            for slab in slabs(rows.column(1), 1 << 20):
                ids = rows.column(0).slice(at, len(slab))
                sets = list(shingles(slab, words))
                one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([mix(s ^ _POWER).sum(dtype=np.uint64) for s in sets], np.uint64)
                both = mix(one + two * _POWER + np.array([len(s) for s in sets], np.uint64))
                yield batch(len(slab), {
                    "id": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(one.view(np.int64)), "s2": pa.array(two.view(np.int64)),
                    "s": pa.array(both.view(np.int64)), "v": pa.array([stored(count_vector(s)) for s in sets], pa.binary()),
                    "o": pa.array([odd_sketch(s).tobytes() for s in sets], pa.binary()),
                })
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                of = [k for k, s in enumerate(sets) if known[k] and len(s) >= least]
                found = list(packed([entries(sets[k], percent) for k in of], both[of], ranges))
                if found:
                    yield batch(len(found), {"grp": pa.array([f[0] for f in found], pa.int64()), "data": pa.array([f[1] for f in found], pa.binary())})
                at += len(slab)

    rows = docs.select(F.col(key).cast("bigint"), F.col(text))
    return save(rows.mapInArrow(sign, "id bigint, n bigint, s1 bigint, s2 bigint, s bigint, v binary, o binary, grp bigint, data binary"), "signatures", BATCH_BYTES)


def index_members(signed: DataFrame, classes: DataFrame, ranges: int) -> DataFrame:
    """(entry, id, b) of entries that two representatives or more stand under; b is the smallest of them."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            for entry, sets in shared_entries(parts, of, ranges) if parts else ():
                yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(sets.astype(np.uint64).view(np.int64))], names=["entry", "s"])

        for some in batches:
            for group, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if group != of:
                    yield from rows()
                    of, parts = group, []
                parts.append(data)
        yield from rows()

    dealt = signed.where("data IS NOT NULL").select("grp", "data").repartition("grp").sortWithinPartitions("grp")
    found = dealt.mapInArrow(share, "entry bigint, s bigint")
    # A set's hash tells its representative; two sets of one hash would only make more candidates.
    members = save(found.join(classes.select("s", F.col("rep").alias("id")), "s").select("entry", "id").distinct(), "members", BATCH_BYTES)
    first = members.groupBy("entry").agg(F.min("id").alias("b"))
    return members.join(first, "entry")


def _may_link(percent: int) -> Callable:
    """Whether the sum of coordinate minima, an upper bound of the intersection, reaches percent / (100 + percent) of both sizes."""

    @F.arrow_udf(BooleanType())
    def may_link(va: pa.Array, vb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, m in zip(va.to_pylist(), vb.to_pylist(), (na.to_numpy() + nb.to_numpy()).tolist()):
            x, y = loaded(x), loaded(y)
            size = min(len(x), len(y))
            out.append((100 + percent) * int(np.minimum(fold(x, size), fold(y, size)).sum()) >= percent * m)
        return pa.array(out, pa.bool_())

    return may_link


def _near_enough(percent: int) -> Callable:
    """Whether slots in which two odd sketches differ, a lower bound of the shingles in which the sets differ, are as few
    as a link allows."""

    @F.arrow_udf(BooleanType())
    def near_enough(oa: pa.Array, ob: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, m in zip(oa.to_pylist(), ob.to_pylist(), (na.to_numpy() + nb.to_numpy()).tolist()):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(fold_sketch(x, size) ^ fold_sketch(y, size)).sum())
            out.append((100 + percent) * differ <= (100 - percent) * m)
        return pa.array(out, pa.bool_())

    return near_enough


def within_bound(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose count vectors and then whose odd sketches allow a link."""
    for vector, test in (("v", _may_link(percent)), ("o", _near_enough(percent))):
        side = nodes.select("id", "n", vector)
        left = side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(vector).alias("va"))
        right = side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(vector).alias("vb"))
        pairs = pairs.join(left, "a").join(right, "b").where(test("va", "vb", "na", "nb")).select("a", "b").distinct()
        pairs = save(pairs, f"bound-{vector}", BATCH_BYTES) if vector == "v" else pairs
    return pairs


def _linked(words: int, percent: int) -> Callable:
    """Whether two whole texts link. Texts that repeat in a run of rows are shingled once."""

    @F.arrow_udf(BooleanType())
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out, known = [], {}
        lefts, rights = left.to_pylist(), right.to_pylist()
        for a, b in zip(lefts, rights):
            sets = []
            for t in (a, b):
                if t not in known:
                    if len(known) > 256:
                        known.clear()
                    known[t] = next(shingles(pa.array([t], pa.string()), words))
                sets.append(known[t])
            common = len(np.intersect1d(*sets, assume_unique=True))
            out.append(common > 0 and 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
        return pa.array(out, pa.bool_())

    return linked


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int = N, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole texts. Only texts of ids in pairs are fetched."""
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    left = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(_linked(words, percent)("ta", "tb")).select("a", "b").distinct()


def rtree_pairs(n: np.ndarray, v: np.ndarray, component: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """Index pairs of points in different components whose count vectors allow a link.

    The points are packed by size and leading counts into pages of ``PAGE``, pages into pages above them; two trees
    (the same one twice) are walked together from the root, and pairs of boxes are dropped as early as they can be.
    ``side`` (0 or 1 per point) restricts pairs to points of different sides.
    """
    order = np.lexsort((v[:, 1], v[:, 0], n))
    high, size = v[order], n[order]
    rows = max(1, (1 << 22) // v.shape[1])
    cmin, cmax = component[order], component[order]
    levels = [(high, size, cmin, cmax)]
    while len(levels[-1][1]) > 1:
        high, size, cmin, cmax = levels[-1]
        at = np.arange(0, len(size), PAGE)
        levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(size, at), np.minimum.reduceat(cmin, at), np.maximum.reduceat(cmax, at)))
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        high, size, cmin, cmax = levels[depth]
        keep = [np.zeros(0, np.int64)]
        for i in range(0, len(a), rows):
            x, y = a[i : i + rows], b[i : i + rows]
            bound = np.minimum(high[x], high[y]).sum(axis=1)
            ok = (100 + percent) * bound >= percent * (size[x] + size[y])
            ok &= (np.minimum(cmin[x], cmin[y]) != np.maximum(cmax[x], cmax[y]))
            keep.append(np.flatnonzero(ok) + i)
        kept = np.concatenate(keep)
        a, b = a[kept], b[kept]
        if depth == 0:
            break
        # Children of each surviving pair; a page with itself gives each pair of children once.
        below = len(levels[depth - 1][1])
        grid = np.arange(PAGE)
        x = (a[:, None, None] * PAGE + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
        y = (b[:, None, None] * PAGE + 0 * grid[None, :, None] + grid[None, None, :]).ravel()
        ok = (x < below) & (y < below) & (x <= y)
        a, b = x[ok], y[ok]
    a, b = order[a], order[b]
    ok = a != b
    if side is not None:
        ok &= side[a] != side[b]
    return np.stack([a[ok], b[ok]], 1)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, over the bounds of batches."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        values = np.stack([rows.column(k).to_numpy() for k in range(keys)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield rows.slice(a, b - a)
        rest = rows.slice(bounds[-1])
    if rest is not None and len(rest):
        yield rest


def sketched_pairs(pairs: np.ndarray, n: np.ndarray, sketches: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose odd sketches allow a link, and the slots in which each differs."""
    step = max(1, (1 << 24) // sketches.shape[1])
    differ = np.concatenate([np.zeros(0, np.int64)] + [
        np.bitwise_count(sketches[p[:, 0]] ^ sketches[p[:, 1]]).sum(axis=1, dtype=np.int64) for p in (pairs[i : i + step] for i in range(0, len(pairs), step))
    ])
    ok = (100 + percent) * differ <= (100 - percent) * (n[pairs[:, 0]] + n[pairs[:, 1]])
    return pairs[ok], differ[ok]


def forest(pairs: np.ndarray, differ: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Of the pairs, a forest over the components, the likest pairs first: fewer pairs than there are components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i in np.argsort(differ, kind="stable").tolist():
        x, y = (find(int(component[k])) for k in pairs[i])
        if x != y:
            root[x] = y
            kept.append(i)
    return pairs[kept]


def _join_groups(percent: int, whole: bool) -> Callable:
    """Pairs of each group (entry, i, j) by an R-tree; columns entry, i, j, own, id, c, n, v, o. All of them if ``whole``; else
    a forest, and one row with the entry and no pair if there were more."""

    def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            entry, i, j = (group.column(k)[0].as_py() for k in range(3))
            own, ids, c, n = (group.column(k).to_numpy() for k in (3, 4, 5, 6))
            vectors = [loaded(x) for x in group.column(7).to_pylist()]
            size = min(map(len, vectors))
            side = None if i == j else (own == j).astype(np.int8)
            found = rtree_pairs(n, np.stack([fold(x, size) for x in vectors]), c, side, percent)
            sketches = [np.frombuffer(x, np.uint8) for x in group.column(8).to_pylist()]
            size = min(map(len, sketches))
            found, differ = sketched_pairs(found, n, np.stack([fold_sketch(x, size) for x in sketches]), percent)
            given = found if whole else forest(found, differ, c)
            x, y = ids[given[:, 0]], ids[given[:, 1]]
            a, b, more = pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.nulls(len(x), pa.int64())
            if len(given) < len(found):
                a, b, more = (pa.concat_arrays([p, pa.array([q], pa.int64())]) for p, q in ((a, None), (b, None), (more, entry)))
            yield pa.RecordBatch.from_arrays([a, b, more], names=["a", "b", "more"])

    return join_groups


def hidden_pairs(members: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int = PERCENT, whole: bool = True) -> DataFrame:
    """Pairs (a, b) that share an index entry, lie in different components and pass the bounds; without ``whole`` a forest of
    them for each entry. ``more`` is an entry that had more pairs than its forest; such a row has no pair."""
    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")
    placed = save(placed, "entries")
    sets = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    mixed = placed.groupBy("entry").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("m"), *sets).where("x <> y")
    mixed = save(mixed.groupBy("m", "h0", "h1").agg(F.min("entry").alias("entry")).select("entry", "m"), "mixed")
    open_ = placed.join(mixed, "entry").join(nodes.select("id", "n", "v", "o"), "id")
    # Blocks of an entry: one block is joined with itself, more are dealt out as all pairs of blocks.
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("entry", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c", "n", "v", "o")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    return dealt.mapInArrow(_join_groups(percent, whole), "a bigint, b bigint, more bigint").distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row: ``key``, n_shingles, component_id (smallest key reachable by links, its own without links)."""
    ranges = max(LEAST_RANGES, math.ceil(math.log2(max(1, docs.count() * ENTRIES_PER_ROW / RANGE_ENTRIES))))
    everything = signatures(docs, key, text, words, percent, ranges)
    signed = everything.where("data IS NULL")
    linkable = signed.where("id IS NOT NULL AND n > 0")
    classes = save(linkable.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("s").alias("s")), "classes")
    nodes = save(
        linkable.join(classes.select("n", "s1", "s2", F.col("rep").alias("id")), ["id", "n", "s1", "s2"], "left_semi")
        .dropDuplicates(["id", "s1", "s2"]).select("id", "n", "v", "o"), "nodes",
    )
    members = save(index_members(everything, classes, ranges), "index")
    star = members.where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    tested = save(within_bound(star, nodes, percent), "star", BATCH_BYTES)
    links = save(verify(tested, docs, key, text, words, percent), "links", BATCH_BYTES)

    placed = signed.select("id", "n", "s1", "s2").join(classes.drop("s"), ["n", "s1", "s2"], "left")
    placed = save(placed.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))).select("id", "n", "rep"), "placed")
    # Rows of one key with different sets: their representatives are linked to the smallest one.
    repeated = placed.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("_x")).where("b <> _x").select("id", "b")
    same_key = placed.join(repeated, "id").where("rep <> b").select(F.col("rep").alias("a"), "b")

    links = links.unionByName(same_key)
    roots, searched = components(links), members.select("entry", "id")
    for whole in (False, True):
        hidden = save(hidden_pairs(searched, roots, nodes, percent, whole), "hidden", BATCH_BYTES)
        pairs = save(hidden.where("more IS NULL").select("a", "b").join(tested, ["a", "b"], "left_anti"), "untested")
        if not pairs.isEmpty():
            links = save(links.unionByName(verify(pairs, docs, key, text, words, percent)), "links", BATCH_BYTES)
            roots, tested = components(links), tested.unionByName(pairs)
        left = hidden.where("more IS NOT NULL").select(F.col("more").alias("entry")).distinct()
        if whole or left.isEmpty():
            break
        searched = searched.join(left, "entry", "left_semi")
    final = placed.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return final.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")).alias("component_id"),
    )


def keep_first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns as they are: one for each component, the one with
    the smallest key; of rows that share it, one. Rows without a key stay."""
    keep = jaccard_components(docs, key, text, words, percent).where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(keep, key, "left_semi").dropDuplicates([key])
    return kept.select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
