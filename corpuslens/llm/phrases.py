"""Collocations by multikey three-way quicksort of suffix pointers.

A suffix starts at each word and holds up to ``MAX_WORDS`` words of its piece. Suffixes are routed by their leading words
to tasks, which sort them: a partition of pointers is split by one word at a time into less, equal and greater; equal
ones go on with the next word, and their number is the count of the words so far. Partitions that are too small to
hold a phrase often enough are abandoned. All partitions of a task are split in step, by numpy.

Before, one pass counts single words and, in a sketch of 2^``BITS`` counters, pairs of neighbouring words. A counter below
the wanted count rules its pairs out, so suffixes end where such a pair begins and most are never sent; a full sketch
rules out nothing, and only costs. Equal suffixes of a run of text are sent once, with their number, and packed: those of one
language and route group make one row of a small vocabulary and a compressed array of codes. A group gets ``FAN`` routes
of a level; if many suffixes are to be expected, further levels part the groups again. A pair with more than ``HEAVY``
suffixes is routed by all words instead of two; the counts of its shorter phrases are partial in each task and summed
afterwards. The sketch's bits are all that is broadcast: two times 2^``BITS`` bits.

NULL texts are empty; a NULL language is ``und``. Repeated rows count each time. A table without words gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import save, segments

MAX_WORDS = 5
#: Counters of the pair sketch, as a power of two; for a corpus of n words take about log2(n / 40).
BITS = 22
#: Counters of one row of the sketch on its way to its sum.
CELLS = 4096
HEAVY = 200_000
#: Bytes of text whose equal suffixes are merged before they are sent.
RUN_BYTES = 4 << 20
#: Parts that a level of routing makes of a group, and the suffixes that a group may be expected to hold in the end.
FAN, GROUP_ROWS = 64, 2_000_000
#: Slices that a language's phrases are ranked in before the last ranking.
SLICES = 64

BLANK, STOP = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANK)] = 1
KIND[list(STOP)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _pair(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(3) + _mix(second) + lang)


def _cell(pair: np.ndarray, bits: int) -> np.ndarray:
    """The counter of a pair in the sketch."""
    return (pair >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Run:
    """Words of some texts: codes into ``vocabulary``, the language of each, and whether the next one may follow it."""

    vocabulary: pa.Array
    code: np.ndarray
    lang: np.ndarray
    joined: np.ndarray
    hashes: np.ndarray  # of the vocabulary

    def pairs(self, languages: np.ndarray) -> np.ndarray:
        """A hash of each word with the next and its language; only meant where ``joined``."""
        h = self.hashes[self.code]
        return _pair(h[:-1], h[1:], languages[self.lang[:-1]])


def _hash(words: pa.Array) -> np.ndarray:
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], size)
    power = np.cumprod(np.full(int(size.max()) + 1, PRIME, np.uint64), dtype=np.uint64)
    return _mix(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place], at[:-1] - at[0], dtype=np.uint64))


def runs(texts: pa.Array, langs: np.ndarray) -> Iterator[Run]:
    for raw, bounds, rows in segments(texts, STOP, RUN_BYTES):
        kind = KIND[raw]
        inner = kind == 0
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        heads = bounds[:-1][bounds[:-1] < len(raw)]
        begins[heads] |= inner[heads]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        number = np.cumsum(begins)
        size = np.bincount(number[inner] - 1, minlength=len(starts))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[inner]])])
        coded = words.dictionary_encode()
        part = np.searchsorted(bounds, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts]
        joined = (part[1:] == part[:-1]) & (piece[1:] == piece[:-1])
        vocabulary = coded.dictionary
        yield Run(vocabulary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), langs[rows[part]], joined, _hash(vocabulary))


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, the code of each row, and a number for each name."""
    coded = column.cast(pa.string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    return names, coded.indices.to_numpy(zero_copy_only=False), np.array([_number(n) for n in names], np.uint64)


def _number(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) * int(PRIME) % (1 << 64))


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) to counts of words, and at the end of the task its sketch of pairs in rows of ``CELLS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            names, codes, numbers = _languages(batch.column(0))
            for run in runs(batch.column(1), codes):
                size = len(run.vocabulary)
                keys, n = np.unique(run.lang * size + run.code, return_counts=True)
                langs = pa.array(names, pa.string()).take(pa.array(keys // size))
                yield pa.RecordBatch.from_arrays(
                    [langs, run.vocabulary.take(pa.array(keys % size)), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                    names=["lang", "word", "n", "row", "cells"],
                )
                cells, n = np.unique(_cell(run.pairs(numbers)[run.joined], bits), return_counts=True)
                sketch[cells] += n.astype(np.uint32)
        filled = np.flatnonzero(sketch.reshape(-1, min(CELLS, len(sketch))).any(axis=1))
        for rows in np.array_split(filled, max(1, len(filled) // 64)):
            n = len(rows)
            cells = [sketch[r * CELLS : (r + 1) * CELLS].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(rows, pa.int32()), pa.array(cells, pa.binary())],
                names=["lang", "word", "n", "row", "cells"],
            )

    return count


def _merged(least: int, heavy: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of sketches to two bits for each counter of a row, whether it reaches ``least`` and whether it passes ``heavy``,
    and the sum of those that reach ``least``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(cells.as_buffer(), np.uint32)
                sums[row] = sums.get(row, 0) + found.astype(np.int64)
        out = [(r, np.packbits(s >= least).tobytes(), np.packbits(s > heavy).tobytes(), int(s[s >= least].sum())) for r, s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["row", "often", "heavy", "n"])

    return merge


@dataclass
class Suffixes:
    """Distinct suffixes of one language: codes into ``words`` from 1 (0: end), how often each occurs, and whether its pair
    is routed by all words."""

    words: pa.Array
    symbols: np.ndarray
    n: np.ndarray
    split: np.ndarray

    def routes(self, lang: str) -> np.ndarray:
        """The hash that decides on the group of a suffix, level by level."""
        hashes = np.append(np.uint64(0), _hash(self.words.cast(pa.large_string())))
        whole = np.zeros(len(self.n), np.uint64)
        for column in self.symbols.T:
            whole = _mix(whole * np.uint64(5) + hashes[column])
        return np.where(self.split, whole, _pair(hashes[self.symbols[:, 0]], hashes[self.symbols[:, 1]], _number(lang)))

    def merged(self) -> Suffixes:
        """Equal suffixes once."""
        width = len(self.words).bit_length()
        keys = [np.zeros(len(self.n), np.int64)]
        for k, column in enumerate(self.symbols.T):
            if k % (62 // width) == 0:
                keys.append(column.astype(np.int64))
            else:
                keys[-1] = keys[-1] << width | column
        order = np.lexsort(keys)
        fresh = np.append(True, np.logical_or.reduce([np.diff(key[order]) != 0 for key in keys]))
        first = order[fresh]
        return Suffixes(self.words, self.symbols[first], np.add.reduceat(self.n[order], np.flatnonzero(fresh)), self.split[first])

    def parts(self, lang: str, level: int, group: int = 0) -> Iterator[tuple[str, int, str, bytes]]:
        """Packed rows (lang, group, words, data), one for each group of a level of routing below ``group``."""
        part = (self.routes(lang) // np.uint64(FAN**level) % np.uint64(FAN)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)).tolist()
        for i, j in zip(edges, [*edges[1:], len(order)]):
            rows = order[i:j]
            used, codes = np.unique(self.symbols[rows], return_inverse=True)
            if used[0] == 0:
                used = used[1:]
            else:
                codes = codes + 1
            kind = "<u2" if len(used) < 1 << 16 else "<u4"
            data = codes.reshape(len(rows), -1).T.astype(kind).tobytes() + self.n[rows].astype("<i8").tobytes() + self.split[rows].astype(np.uint8).tobytes()
            yield lang, group + int(part[rows[0]]) * FAN**level, "\n".join(self.words.take(pa.array(used - 1)).to_pylist()), zstandard.compress(data, 1)


def _gathered(words: list[str], data: list[bytes], max_words: int) -> Suffixes:
    """The suffixes of packed rows under one vocabulary."""
    lists = [w.split("\n") for w in words]
    coded = pa.array([w for part in lists for w in part], pa.string()).dictionary_encode()
    codes, at = coded.indices.to_numpy().astype(np.int64) + 1, 0
    symbols, n, split = [], [], []
    for part, packed in zip(lists, data):
        raw = zstandard.decompress(packed)
        kind = np.dtype("<u2" if len(part) < 1 << 16 else "<u4")
        rows = len(raw) // (max_words * kind.itemsize + 9)
        table = np.append(0, codes[at : at + len(part)])
        symbols.append(table[np.frombuffer(raw, kind, rows * max_words).reshape(max_words, rows).T])
        n.append(np.frombuffer(raw, "<i8", rows, rows * max_words * kind.itemsize))
        split.append(np.frombuffer(raw, np.uint8, rows, len(raw) - rows).astype(bool))
        at += len(part)
    return Suffixes(coded.dictionary, np.concatenate(symbols), np.concatenate(n), np.concatenate(split))


PACKED = "lang string, grp bigint, words string, data binary"


def _packed(rows: list[tuple[str, int, str, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "grp", "words", "data"])


def _suffixes(shared, bits: int, max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) to the packed suffixes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, heavy = (np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in shared.value)
        for batch in batches:
            names, codes, numbers = _languages(batch.column(0))
            for run in runs(batch.column(1), codes):
                if len(run.code) < 2:
                    continue
                cell = _cell(run.pairs(numbers), bits)
                ok = run.joined & often[cell]
                # Words that follow: one for each pair in a row that may be frequent.
                more = np.zeros(len(run.code), np.int64)
                padded = np.append(ok, np.zeros(max_words, bool))
                going = np.ones(len(run.code), bool)
                for k in range(max_words - 1):
                    going &= padded[k : k + len(going)]
                    more += going
                for lang, name in enumerate(names):
                    at = np.flatnonzero((more > 0) & (run.lang == lang))
                    if len(at):
                        column = np.minimum(at[:, None] + np.arange(max_words), len(run.code) - 1)
                        symbols = np.where(np.arange(max_words) <= more[at, None], run.code[column] + 1, 0)
                        found = Suffixes(run.vocabulary, symbols, np.ones(len(at), np.int64), heavy[cell[at]])
                        yield _packed(list(found.merged().parts(name, 0)))

    return cut


def _groups(batches: Iterator[pa.RecordBatch], max_words: int, most: int | None = None) -> Iterator[tuple[str, int, Suffixes]]:
    """The suffixes of each language and group from rows in that order; merged, and given early, if they pass ``most``."""
    key, words, data, size = None, [], [], 0
    for batch in batches:
        for lang, group, word, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if words and ((lang, group) != key or most is not None and size > most):
                yield *key, _gathered(words, data, max_words).merged()
                words, data, size = [], [], 0
            key = lang, group
            words.append(word)
            data.append(packed)
            size += zstandard.frame_content_size(packed) // (2 * max_words + 9)
    if words:
        yield *key, _gathered(words, data, max_words).merged()


def _parted(level: int, max_words: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows, in order of language and group, to rows of the groups of the next level."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, group, found in _groups(batches, max_words, most):
            yield _packed(list(found.parts(lang, level, group)))

    return part


def multikey_counts(symbols: np.ndarray, weight: np.ndarray, starts: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Three-way quicksort of pointers to the rows of ``symbols`` (0: end). ``starts`` are the bounds of the partitions to
    begin with, ``least`` the weight below which each is abandoned.

    Gives (one row of each, number of symbols, weight) for all leading symbols whose weight is not below that.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    pointer = np.arange(len(symbols))
    size, depth = np.diff(np.append(starts, len(symbols))), np.zeros(len(starts), np.int64)
    while len(pointer):
        at = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        value = symbols[pointer, depth[of]]
        a, b, c = value[at], value[at + size // 2], value[at + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        side = (value >= pivot).astype(np.int8) + (value > pivot)
        # Each pointer's new place: its part's start and the number of pointers of the same part before it.
        sizes = np.bincount(of * 3 + side, minlength=3 * len(size))
        begin = np.cumsum(sizes) - sizes
        place = np.empty(len(pointer), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            rank = np.arange(len(mine))
            before = np.cumsum(sizes[k::3]) - sizes[k::3]
            place[mine] = begin[of[mine] * 3 + k] + rank - before[of[mine]]
        moved = np.empty_like(pointer)
        moved[place] = pointer
        filled = np.flatnonzero(sizes)
        total = np.add.reduceat(weight[moved], begin[filled])
        part, kind = filled // 3, filled % 3
        head = moved[begin[filled]]
        ended = (kind == 1) & (symbols[head, depth[part]] == 0)
        stays = (total >= least[part]) & ~ended
        equal = stays & (kind == 1)
        for d in np.unique(depth[part[equal]]).tolist():
            these = equal & (depth[part] == d)
            out.append((head[these], d + 1, total[these]))
        stays &= ~(equal & (depth[part] + 1 == symbols.shape[1]))
        pointer = moved[np.repeat(stays, sizes[filled])]
        depth = depth[part[stays]] + (kind[stays] == 1)
        least, size = least[part[stays]], sizes[filled][stays]
    return out


def _sorter(least: int, max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows, in order of language and group, to phrases: lang, phrase, a. What is not split is complete."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, found in _groups(batches, max_words):
            order = np.argsort(found.split, kind="stable")
            symbols, whole = found.symbols[order], int((~found.split).sum())
            starts = np.array([k for k in (0, whole) if k < len(order) and (k or whole)] or [0])
            limits = np.where(starts < whole, least, 1)
            for rows, depth, total in multikey_counts(symbols, found.n[order], starts, limits):
                if depth > 1 and len(rows):
                    parts = [found.words.take(pa.array(symbols[rows, k] - 1)) for k in range(depth)]
                    phrase = pc.binary_join_element_wise(*parts, " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), phrase, pa.array(total, pa.int64())], names=["lang", "phrase", "a"])

    return sort


def phrase_counts(
    docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", bits: int = BITS, heavy: int = HEAVY, max_words: int = MAX_WORDS, group_rows: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang, phrase, a) of 2 to ``max_words`` words, words (lang, phrase, a), both from ``least`` on, and (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = save(rows.mapInArrow(_counter(bits), "lang string, word string, n bigint, row int, cells binary"), "phrase-words")
    singles = save(counted.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("a")), "phrase-singles")
    sketch = counted.where("row IS NOT NULL").select("row", "cells").repartition("row").mapInArrow(_merged(least, heavy), "row int, often binary, heavy binary, n bigint")
    # A row of the sketch is 1 KB here, and there are 2^bits / CELLS of them whatever the input.
    size, expected = (1 << bits) // 8, 0
    maps = bytearray(size), bytearray(size)
    step = min(CELLS, 1 << bits) // 8
    for row in sketch.collect():
        expected += row.n
        for bitmap, found in zip(maps, (row.often, row.heavy)):
            bitmap[row.row * step : (row.row + 1) * step] = found
    shared = spark.sparkContext.broadcast(tuple(bytes(m) for m in maps))
    packed = rows.mapInArrow(_suffixes(shared, bits, max_words), PACKED)
    level = 1
    while expected > group_rows * FAN**level:
        grouped = packed.repartition("lang", "grp").sortWithinPartitions("lang", "grp")
        packed = grouped.mapInArrow(_parted(level, max_words, group_rows), PACKED)
        level += 1
    grouped = packed.repartition("lang", "grp").sortWithinPartitions("lang", "grp")
    found = grouped.mapInArrow(_sorter(least, max_words), "lang string, phrase string, a bigint")
    phrases = save(found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrase-counts")
    totals = singles.groupBy("lang").agg(F.sum("a").alias("n"))
    return phrases, singles.where(F.col("a") >= least).withColumnRenamed("word", "phrase"), totals


def collocations(
    docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", **sizes: int
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language by their weakest cut. Phrases inside
    a longer one that has at least ``percent`` of their count are left out."""
    phrases, words, totals = phrase_counts(docs, least, text, lang, **sizes)
    parts = F.split("phrase", " ")

    def run(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    # A cut's two parts are phrases or words themselves, so their counts are known.
    known = phrases.unionByName(words)
    cuts = phrases.withColumn("w", parts).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    wide = "decimal(19,0)"
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(f"(CAST(1000 * a AS {wide}) * CAST(n AS {wide})) DIV (CAST(l AS {wide}) * CAST(r AS {wide}))"))
    weakest = F.min(F.struct("score", "k", "l", "r", "n")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")

    # Every shorter run of words of a phrase, with the phrase's count.
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), d -> transform(sequence(1, size(w) - d + 1), i -> array(i, d))))")
    longer = phrases.withColumn("w", parts).where(F.size("w") > 2).select("a", "lang", "w", F.explode(spans).alias("s"))
    longer = longer.select("lang", run(F.col("s")[0], F.col("s")[1]).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a")))

    # Ranked in slices first: no task sees all phrases of a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slice_of = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    best = alone.withColumn("_s", slice_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
