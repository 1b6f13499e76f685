"""What the operators of this package share: written intermediate tables, text as numpy arrays, word splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import scratch_path

#: White space between words: space and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]"
#: Bytes of text that a Python task turns into arrays at a time; a longer document is one piece of its own.
SLAB_BYTES = 2 << 20
#: Bytes of a batch of rows on its way between Spark and a Python task. Spark's own bound, 10000 rows or 64 MB, is held by the
#: executor and its Python worker at once, for each core, and is kept by their allocators afterwards.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """What runs inside passes rows to Python tasks in batches of about ``size`` bytes; a session with a smaller bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    number = before.rstrip("b")
    if size is None or (number.isdigit() and 0 < int(number) <= size):
        yield
        return
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def save(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes a frame below the shared folder and reads it back: it is computed once, its lineage ends there, and
    a lost executor loses nothing of it. ``batch_bytes`` bounds the batches that its Python tasks receive.

    zstd keeps its buffers only while a file is open. The default codec leaves direct buffers behind for each file,
    which pile up outside the heap over the many small files of iterative jobs.
    """
    path = scratch_path(df.sparkSession, label)
    with batches_of(df.sparkSession, batch_bytes):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text as an array; a NULL text has none. A one-pass split, then empty pieces go."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def fold(key: Column) -> Column:
    """The remainder that decides which labelled rows may be learned from: crc32 of the id as text, modulo 5."""
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % 5


def with_verdict(docs: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """The rows whose computed ``value`` is to be kept, with their columns as they are. The helper column gets a name
    that no column has."""
    name = fresh_name(docs, "verdict")
    return docs.withColumn(name, value).where(keep(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` needs; names ignore case, as Spark's do."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (NULL: empty) and the offsets of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slabs(texts: pa.Array, limit: int = SLAB_BYTES) -> Iterator[pa.Array]:
    """Cuts an Arrow batch into runs of whole texts of about ``limit`` bytes, so that memory has a bound."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at = utf8(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def segments(texts: pa.Array, breaks: bytes, limit: int = SLAB_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts the texts of an Arrow batch into runs of about ``limit`` bytes, long texts after a byte of ``breaks``, so that
    arrays made of a run have a bound whatever the length of a text; only a stretch without such a byte stays whole.

    Gives the bytes of a run, the offsets of its parts, and the number of the text that each part belongs to.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw, at = utf8(texts)
    is_break = np.isin(np.arange(256), np.frombuffer(breaks, np.uint8))
    cuts: list[tuple[int, int]] = []
    for row in np.flatnonzero(np.diff(at) > limit).tolist():
        place, end = int(at[row]), int(at[row + 1])
        while place + limit < end:
            place += limit
            while place < end and not len(found := np.flatnonzero(is_break[raw[place - 1 : min(place - 1 + limit, end)]])):
                place += limit
            place = end if place >= end else place + int(found[0])
            if place < end:
                cuts.append((row, place))
    rows = np.concatenate([np.arange(len(texts)), np.array([c[0] for c in cuts], np.int64)])
    starts = np.concatenate([at[:-1], np.array([c[1] for c in cuts], np.int64)])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends = np.append(starts[1:], at[-1:])
    first = 0
    while first < len(rows):
        stop = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        yield raw[starts[first] : ends[stop - 1]], np.append(starts[first:stop], ends[stop - 1]) - starts[first], rows[first:stop]
        first = stop
