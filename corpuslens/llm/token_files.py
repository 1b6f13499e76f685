"""Token-id files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

A file holds a run of documents in key order. Its ids are replaced by their rank in the file's own frequency table
(ties by id), so frequent ids take one byte. Four ranks share a control byte (two bits each: bytes less one); data
bytes follow in a separate block. numpy decodes by a 256-row table of the lengths behind each control byte.

Layout, little-endian: magic ``CLT1``, four uint64 (documents, ids, table size, data bytes), document keys int64, one
byte per document (1: key is NULL), ids per document uint64, the table uint32, control bytes, data bytes.

Rows are ordered by key (NULL first), equal keys by text, so repeated rows are all written. NULL texts are empty and
hold the end id alone. An empty table writes no file. Tasks write files under names of their own attempt; only those
that the manifest of successful tasks names are read, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import SLAB_BYTES, save, slabs
from corpuslens.llm.tokens import default_tokenizer, encoder
from corpuslens.session import scratch_path

MAGIC = b"CLT1"
#: A file is closed once it holds so many ids; they are kept in memory until then (4 bytes each).
FILE_IDS = 4 << 20
#: Bytes of each of the four ranks behind a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    cells = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), cells[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.append(data, np.zeros(4, np.uint8))
    ranks = padded[at].astype(np.uint32)
    for byte in range(1, 4):
        more = np.flatnonzero(size > byte)
        ranks[more] |= padded[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def encode_file(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    top = int(ids.max()) + 1 if len(ids) else 0
    frequency = np.bincount(ids, minlength=top)
    table = np.lexsort((np.arange(top), -frequency))[: int((frequency > 0).sum())].astype("<u4")
    rank = np.zeros(top, np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack(rank[ids])
    head = MAGIC + struct.pack("<4Q", len(keys), len(ids), len(table), len(data))
    key = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    null = np.array([k is None for k in keys], np.uint8).tobytes()
    return b"".join([head, key, null, counts.astype("<u8").tobytes(), table.tobytes(), control, data])


def decode_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids per document and all ids of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, size, n_data = struct.unpack_from("<4Q", content, 4)
    at = 36

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(content, kind, k, at)
        at += values.nbytes
        return values

    keys, null, counts, table = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", size)
    ranks = unpack(take("u1", -(-n // 4)), take("u1", n_data), n)
    return [None if z else int(k) for k, z in zip(keys, null)], counts.astype(np.int64), table[ranks]


def write_token_files(
    docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None, folder: str | None = None, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encodes all texts, each ended by ``end_id``, into files below ``folder`` (shared) in ascending key order.

    Gives the manifest, one row per file: path, part, file_no (order within the part), n_docs, n_ids, n_bytes.
    """
    from pyarrow import fs

    path = tokenizer or default_tokenizer()
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        coder, keys, parts, counts, number = encoder(path), [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, parts, counts, number
            ids, n_docs = np.concatenate(parts), len(keys)
            content = encode_file(keys, np.concatenate(counts), ids)
            name = f"{root}/{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.tokens"
            with store.open_output_stream(name) as out:
                out.write(content)
            row = [[name], [task.partitionId()], [number], [n_docs], [len(ids)], [len(content)]]
            keys, parts, counts, number = [], [], [], number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, KINDS)], names=NAMES)

        for batch in batches:
            at = 0
            for slab in slabs(batch.column(1), min(SLAB_BYTES, 2 * file_ids)):
                ids, n = coder.encode(slab)
                # The end id goes behind each text: insert at the end of every document.
                parts.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint32))
                counts.append(n + 1)
                keys += batch.column(0).slice(at, len(slab)).to_pylist()
                at += len(slab)
                if sum(map(len, parts)) >= file_ids:
                    yield close()
        if keys:
            yield close()

    KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    NAMES = ["path", "part", "file_no", "n_docs", "n_ids", "n_bytes"]
    ordered = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    ordered = ordered.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return save(ordered.mapInArrow(write, "path string, part int, file_no int, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all files before this one: totals of parts first, then within each part."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    ahead = totals.select("part", F.coalesce(F.sum("_n").over(before.orderBy("part")), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("file_no")), F.lit(0))
    return manifest.withColumn("_inside", inside).join(ahead, "part").withColumn("start", F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def read_token_files(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: ``key``, start, n_tokens, ids_crc32 and file.

    ``ids_crc32`` is the crc32 of its ids as unsigned little-endian 32-bit integers.
    """
    from pyarrow import fs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(path) as source:
                    keys, counts, ids = decode_file(source.read())
                at = np.append(0, np.cumsum(counts))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
                columns = [
                    pa.array(keys, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array([path.rsplit("/", 1)[1]] * len(keys), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32", "file"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = with_starts(manifest).select("path", "start").repartition(tasks)
    return files.mapInArrow(read, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def token_files_roundtrip(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Writes the files and reads them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, key, text, end_id, folder=folder), folder, key)
