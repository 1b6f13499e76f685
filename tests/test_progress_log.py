"""Progress logs: resuming by offsets, lines in progress, malformed lines, splits inside files, expiry."""

import json
import os

import pytest

from corpuslens.sources.progress_log import LogReader, expire_logs, log_stream, push_progress, write_logs


def run(spark, folder, base, **options):
    """Everything that is there now, on top of what earlier runs over the same checkpoint have written."""
    stream = log_stream(spark, str(folder), **options)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return sorted((r.analysis_id, r.status, r.progress_percent) for r in spark.read.schema(stream.schema).parquet(f"{base}/out").collect())


def test_a_restarted_stream_reads_only_unseen_events(spark, tmp_path):
    logs, base = tmp_path / "logs", tmp_path / "base"
    push_progress(str(logs), "a/1", "cloning", 5)
    push_progress(str(logs), "b", "failed", 0, "no such branch")
    first = [("a/1", "cloning", 5), ("b", "failed", 0)]
    assert run(spark, logs, base) == first
    assert run(spark, logs, base) == first
    push_progress(str(logs), "a/1", "complete", 100)
    push_progress(str(logs), "c", "cloning", 5, writer="other")
    with open(logs / "b" / "log.jsonl", "ab") as log:
        log.write(b'not json\n[1]\n"x"\n{"unknown": 1}\n\xff\n\n{"status": "pending"')
    assert run(spark, logs, base) == sorted([*first, ("a/1", "complete", 100), ("c", "cloning", 5)])
    with open(logs / "b" / "log.jsonl", "ab") as log:
        log.write(b', "progress_percent": 1}\n')
    assert run(spark, logs, base) == sorted([*first, ("a/1", "complete", 100), ("c", "cloning", 5), ("b", "pending", 1)])


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_ranges_split_files_anywhere(tmp_path, part):
    (tmp_path / "a").mkdir()
    lines = [json.dumps({"status": "é" * (i % 9), "n": i}) for i in range(60)] + ["", "x"]
    (tmp_path / "a/log.jsonl").write_text("\n".join(lines) + "\nunfinished")
    reader = LogReader({"path": str(tmp_path), "partBytes": str(part)})
    end = reader.latestOffset()
    assert end == {"a/log.jsonl": len("\n".join(lines).encode()) + 1} == reader.latestOffset()
    got = [r["value"] for p in reader.partitions({}, end) for batch in reader.read(p) for r in batch.to_pylist()]
    assert got == lines
    middle = {"a/log.jsonl": len("\n".join(lines[:20]).encode()) + 1}
    assert [r["value"] for p in reader.partitions(middle, end) for batch in reader.read(p) for r in batch.to_pylist()] == lines[20:]


def test_logs_expire_and_begin_again(spark, tmp_path):
    logs, base = tmp_path / "logs", tmp_path / "base"
    push_progress(str(logs), "old", "cloning", 5)
    push_progress(str(logs), "new", "cloning", 5)
    assert run(spark, logs, base) == [("new", "cloning", 5), ("old", "cloning", 5)]
    os.utime(logs / "old/log.jsonl", (1, 1))
    assert expire_logs(str(logs)) == ["old"] and expire_logs(str(tmp_path / "none")) == []
    assert run(spark, logs, base) == [("new", "cloning", 5), ("old", "cloning", 5)]
    push_progress(str(logs), "old", "pending", 0)
    assert run(spark, logs, base) == [("new", "cloning", 5), ("old", "cloning", 5), ("old", "pending", 0)]


def test_written_logs_keep_the_order_of_an_analysis(spark, tmp_path):
    rows = [(f"a{i % 3}", f'{{"status": "s{i}"}}', 1000 - i) for i in range(300)]
    lines = spark.createDataFrame(rows, "analysis_id string, value string, ts int").repartition(5)
    assert write_logs(lines, str(tmp_path)) == 300
    reader = LogReader({"path": str(tmp_path)})
    got = {}
    for part in reader.partitions({}, reader.latestOffset()):
        for batch in reader.read(part):
            for r in batch.to_pylist():
                got.setdefault(r["file"], []).append(int(json.loads(r["value"])["status"][1:]))
    assert all(v == sorted(v, reverse=True) for v in got.values()) and sum(map(len, got.values())) == 300


def test_no_logs(spark, tmp_path):
    assert run(spark, tmp_path / "none", tmp_path / "base") == []
    with pytest.raises(ValueError):
        LogReader({"path": "s3a://bucket/logs"})
