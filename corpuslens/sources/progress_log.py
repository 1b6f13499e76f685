"""Progress logs as a stream with offsets of their own.

A log folder holds one folder per analysis, and in it one append-only file for each writer, with one JSON event a line. A
reader's offset says for each file how many bytes it has read, up to the end of a line; so a stopped stream goes on with
exactly the lines it has not seen, of every analysis by itself, and a line that is still being written waits. Lines that
are no event are passed over. Logs that have been silent for the lifetime of a list are removed by ``expire_logs``; offsets
only speak of files that are there, which bounds them by the analyses that are alive.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpuslens.operators.progress import TTL_SECONDS
from corpuslens.sources.tree import local_path

LINES = "analysis_id string, file string, position bigint, value string"
EVENT = "event_id bigint, status string, progress_percent int, error_message string, ts timestamp"
#: Bytes of one partition of a micro-batch, and of a read inside it.
PART_BYTES, READ_BYTES = 32 << 20, 1 << 20


def push_progress(folder: str, analysis_id: str, status: str, percent: int | None, error_message: str | None = None, writer: str = "log", **more: Any) -> None:
    """Appends an event to an analysis's log, in one write."""
    place = os.path.join(_folder(folder), quote(analysis_id, safe=""))
    os.makedirs(place, exist_ok=True)
    event = {"status": status, "progress_percent": percent, **({"error_message": error_message} if error_message else {}), **more}
    event.setdefault("ts", datetime.now().astimezone().isoformat())
    handle = os.open(os.path.join(place, f"{writer}.jsonl"), os.O_WRONLY | os.O_CREAT | os.O_APPEND)
    try:
        os.write(handle, json.dumps(event).encode() + b"\n")
    finally:
        os.close(handle)


def write_logs(lines: DataFrame, folder: str) -> int:
    """Writes ``value`` of (analysis_id, value) as logs, in order of ``ts`` within each analysis: every task appends to files
    of its own, which appear when they are whole. Gives the number of lines."""
    base = _folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, key, handle, n = uuid.uuid4().hex, None, None, 0
        for batch in batches:
            for analysis, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if analysis != key:
                    _close(handle)
                    place = os.path.join(base, quote(analysis, safe=""))
                    os.makedirs(place, exist_ok=True)
                    key, handle = analysis, open(os.path.join(place, f"{name}.part"), "wb")
                handle.write(value.encode() + b"\n")
                n += 1
        _close(handle)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ordered = lines.select("analysis_id", "value", "ts").repartitionByRange("analysis_id", "ts").sortWithinPartitions("analysis_id", "ts")
    return ordered.select("analysis_id", "value").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def _close(handle: Any) -> None:
    if handle is not None:
        handle.close()
        os.replace(handle.name, handle.name.removesuffix(".part") + ".jsonl")


def expire_logs(folder: str, ttl_seconds: int = TTL_SECONDS, now: float | None = None) -> list[str]:
    """Removes the logs of analyses that have been silent for ``ttl_seconds``; gives their ids."""
    base, gone = _folder(folder), []
    for entry in list(os.scandir(base)) if os.path.isdir(base) else []:
        files = list(os.scandir(entry.path)) if entry.is_dir() else []
        if files and max(f.stat().st_mtime for f in files) + ttl_seconds <= (now or time.time()):
            for file in files:
                os.unlink(file.path)
            os.rmdir(entry.path)
            gone.append(unquote(entry.name))
    return sorted(gone)


def _folder(folder: str) -> str:
    base = local_path(folder)
    if base is None:
        raise ValueError(f"cannot read logs below {folder}: give a mounted folder")
    return base


def _whole(path: str, seen: int) -> int:
    """Bytes up to the end of the last whole line, looked for from the end back to ``seen``."""
    with open(path, "rb") as file:
        at = file.seek(0, os.SEEK_END)
        while at > seen:
            low = max(seen, at - READ_BYTES)
            file.seek(low)
            cut = file.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return seen


@dataclass
class Ranges(InputPartition):
    """(file, from, to) of the bytes that one task reads."""

    ranges: list[tuple[str, int, int]]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.base = _folder(options["path"])
        self.part_bytes = int(options.get("partBytes", str(PART_BYTES)))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found: dict[str, int] = {}
        for analysis in os.scandir(self.base) if os.path.isdir(self.base) else ():
            for file in os.scandir(analysis.path) if analysis.is_dir() else ():
                if file.name.endswith(".jsonl"):
                    name, size = f"{analysis.name}/{file.name}", file.stat().st_size
                    seen = self.seen.get(name, 0)
                    found[name] = size if size == seen else _whole(file.path, min(seen, size))
        self.seen = found
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[list[tuple[str, int, int]]] = [[]]
        held = 0
        for name, stop in sorted(end.items()):
            at = start.get(name, 0)
            while at < stop:
                # Ranges may end inside a line: a task reads the lines that begin in its range.
                step = min(stop - at, self.part_bytes - held)
                parts[-1].append((name, at, at + step))
                at, held = at + step, held + step
                if held >= self.part_bytes:
                    parts.append([])
                    held = 0
        return [Ranges(p) for p in parts if p]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for name, low, high in partition.ranges:
            analysis = unquote(name.split("/")[0])
            try:
                file = open(os.path.join(self.base, name), "rb")
            except FileNotFoundError:  # expired since
                continue
            with file:
                file.seek(max(0, low - 1))
                if low:
                    file.readline()  # the rest of a line that began before, or the line feed before this range
                at, rows = file.tell(), []
                while at < high:
                    line = file.readline()
                    if not line.endswith(b"\n"):
                        break
                    rows.append((at, line[:-1].decode("utf-8", "replace")))
                    at += len(line)
                    if len(rows) == 5000 or at >= high:
                        yield self._batch(analysis, name, rows)
                        rows = []
                if rows:
                    yield self._batch(analysis, name, rows)

    def commit(self, end: dict) -> None:
        pass

    @staticmethod
    def _batch(analysis: str, name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([analysis] * n), pa.array([name] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])],
            names=["analysis_id", "file", "position", "value"],
        )


class LogSource(DataSource):
    """``spark.readStream.format("progress_log").load(folder)``: lines with their analysis, file and position."""

    @classmethod
    def name(cls) -> str:
        return "progress_log"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return LogReader(self.options)


def log_stream(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Events of all logs: analysis_id and ``EVENT``; without an event_id of its own an event has its position in the file."""
    spark.dataSource.register(LogSource)
    lines = spark.readStream.format("progress_log").option("partBytes", str(part_bytes)).load(folder)
    event = F.from_json("value", EVENT)
    return lines.select("analysis_id", "position", event.alias("_e")).where(F.coalesce(F.col("_e.status"), F.col("_e.progress_percent").cast("string")).isNotNull()).select(
        "analysis_id", F.coalesce("_e.event_id", "position").alias("event_id"), "_e.status", "_e.progress_percent", "_e.error_message", "_e.ts"
    )
