import json
import os
import random
import uuid
from datetime import datetime, timedelta

from corpuslens.operators.progress import latest_status, progress_sessions, stage_durations
from corpuslens.operators.rules import match_rules
from corpuslens.schemas import FILES
from corpuslens.streaming.progress import latest_status_stream, parse_events, progress_sessions_stream, progress_stream, stage_durations_stream, stage_events_stream
from corpuslens.streaming.scan import dedup_stream, run_available, run_updates, stream_rules
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
EVENTS = [  # analysis, second, status, percent
    ("done", 0, "cloning", 5), ("done", 60, "building_index", 60), ("done", 90, "complete", 100),
    ("bad", 0, "cloning", 5), ("bad", 30, "failed", None),
    ("quiet", 0, "cloning", 5), ("quiet", 3599, "detecting_languages", 20), ("quiet", 3599 + 3601, "cloning", 5),
    ("late", 500_000, "cloning", 5),
]


def write_events(folder, files=3):
    for k in range(files):
        lines = [json.dumps({"analysis_id": a, "event_id": i, "status": s, "progress_percent": p, "ts": (T0 + timedelta(seconds=sec)).isoformat()})
                 for i, (a, sec, s, p) in enumerate(EVENTS) if i * files // len(EVENTS) == k]
        (folder / f"{k}.json").write_text("\n".join(["not json", *lines, '{"x": 1}']))


def test_progress_streams_agree_with_batch(spark, tmp_path):
    write_events(tmp_path)
    batch = parse_events(spark.read.text(str(tmp_path)))
    assert batch.count() == len(EVENTS)
    status = {r.analysis_id: r.status for r in latest_status(batch).collect()}
    assert status == {"done": "complete", "bad": "failed", "quiet": "cloning", "late": "cloning"}
    stream = run_updates(latest_status_stream(progress_stream(spark, str(tmp_path), 1)), ["analysis_id"], "t-latest", newest=("ts",))
    assert {r.analysis_id: r.status for r in stream.collect()} == status

    sessions = {(r.analysis_id, r.events, r.state) for r in progress_sessions(batch).collect()}
    assert sessions == {("done", 3, "complete"), ("bad", 2, "failed"), ("quiet", 2, "stalled"), ("quiet", 1, "stalled"), ("late", 1, "stalled")}
    expired = run_available(progress_sessions_stream(progress_stream(spark, str(tmp_path))), "t-sessions")
    assert {(r.analysis_id, r.events, r.state) for r in expired.collect()} == sessions - {("late", 1, "stalled")}

    seconds = {(r.analysis_id, r.status): r.seconds for r in stage_durations(batch).collect()}
    assert seconds["done", "cloning"] == 60 and seconds["done", "building_index"] == 30 and seconds["done", "complete"] is None
    streamed = run_available(stage_durations_stream(progress_stream(spark, str(tmp_path), 1), ended=()), "t-durations")
    assert {(r.analysis_id, r.event_id, r.seconds) for r in streamed.collect()} == {
        (r.analysis_id, r.event_id, r.seconds) for r in stage_durations(batch).where("seconds is not null").collect()}


def test_rule_stream_finds_new_files_once(spark, tmp_path):
    src = str(tmp_path / uuid.uuid4().hex)
    for text in ("eval(x)\n", "eval(x)\n\neval(y)"):
        rows = [("r", "a.py", 5, False, text, True)]
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(src)
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(src)
    found = stream_rules(files, ("security",))
    assert run_available(found, "t-rules").count() == match_rules(spark.read.parquet(src), ("security",)).count() == 3
    once = run_available(dedup_stream(found.withColumn("seen", F.current_timestamp()), "seen"), "t-once")
    assert sorted(r.line_number for r in once.collect()) == [1, 3]


def test_a_stage_longer_than_the_quiet_time_is_kept(spark, tmp_path):
    """Its next event comes long after the watermark has passed it, in a later micro-batch."""
    events = [("A", 0, "cloning"), ("B", 7000, "cloning"), ("B", 9000, "running_static_analysis"), ("A", 10000, "complete"), ("C", 20000, "cloning")]
    for i, (analysis, second, status) in enumerate(events):
        stamp = f"2024-01-01T{second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}Z"
        line = f'{{"analysis_id":"{analysis}","event_id":{i},"status":"{status}","ts":"{stamp}"}}'
        (tmp_path / f"{i}.json").write_text(line)
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    got = run_available(stage_durations_stream(progress_stream(spark, str(tmp_path), 1)), "t-long").collect()
    assert {(r.analysis_id, r.seconds) for r in got} == {("A", 10000), ("B", 2000)}


def arrive(folder, batches):
    """One file for each micro-batch of (analysis, second, status); the order of the list is that of arrival."""
    number = 0
    for k, batch in enumerate(batches):
        lines = []
        for analysis, second, status in batch:
            stamp = (T0 + timedelta(seconds=second)).isoformat()
            lines.append(json.dumps({"analysis_id": analysis, "event_id": number, "status": status, "ts": stamp}))
            number += 1
        (folder / f"{k}.json").write_text("\n".join(lines))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def told(spark, folder, **options):
    rows = run_available(stage_events_stream(progress_stream(spark, str(folder), 1), **options), f"t-{uuid.uuid4().hex}").collect()
    return sorted((r.kind, r.analysis_id, r.event_id, r.seconds) for r in rows)


def test_stages_in_any_order_of_arrival(spark, tmp_path):
    arrive(tmp_path, [[("A", 1000, "cloning")], [("A", 1300, "building_index")], [("A", 1200, "detecting_languages")], [("A", 1400, "complete")], [("B", 9000, "cloning")]])
    assert told(spark, tmp_path) == [("stage", "A", 0, 200), ("stage", "A", 1, 100), ("stage", "A", 2, 100)]


def test_late_events_have_an_output_of_their_own(spark, tmp_path):
    arrive(tmp_path, [[("B", 9000, "cloning")], [("A", 1000, "cloning"), ("A", 8500, "cloning")], [("A", 8700, "complete")], [("C", 9900, "cloning")]])
    got = told(spark, tmp_path)
    assert ("late", "A", 1, None) in got and ("stage", "A", 2, 200) in got
    assert len(got) == 2


def test_stalled_is_told_once_and_later_events_go_on(spark, tmp_path):
    arrive(tmp_path, [
        [("A", 0, "cloning"), ("B", 0, "complete"), ("D", 0, "cloning")], [("C", 5000, "cloning")], [("A", 6000, "complete")], [("B", 6100, "cloning")],
        [("C", 20_000, "complete")], [("E", 40 * 86400, "cloning")], [("D", 40 * 86400 + 5, "complete"), ("E", 41 * 86400, "cloning")],
    ])
    got = told(spark, tmp_path)
    assert [r for r in got if r[1] == "A"] == [("stage", "A", 0, 6000), ("stalled", "A", 0, 3600)]
    assert [r for r in got if r[1] == "B"] == [("stalled", "B", 5, 3600)]  # an ended run: the next event opens another
    assert [r for r in got if r[1] == "C"] == [("stage", "C", 3, 15000), ("stalled", "C", 3, 3600)]
    assert [r for r in got if r[1] == "D"] == [("stalled", "D", 2, 3600)]  # no longer kept after 30 days


def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path):
    """Several micro-batches in an order shuffled within the delay, equal times and one busy analysis."""
    rng = random.Random(5)
    events = []
    for k in range(400):
        analysis = "busy" if rng.random() < 0.4 else f"a{rng.randrange(30)}"
        events.append((analysis, rng.randrange(0, 40_000), rng.choice(["cloning", "building_index", "complete", "failed"])))
    events.sort(key=lambda e: e[1] + rng.random() * 590)
    events.append(("end", 200_000, "cloning"))
    arrive(tmp_path, [events[i : i + 45] for i in range(0, len(events), 45)])
    batch = stage_durations(parse_events(spark.read.text(str(tmp_path)))).where("seconds IS NOT NULL").collect()
    want = {(r.analysis_id, r.event_id, r.seconds) for r in batch if r.status not in ("complete", "failed") or r.seconds <= 3600}
    got = told(spark, tmp_path)
    assert {r[1:] for r in got if r[0] == "stage"} == want and len(want) > 200
    assert not [r for r in got if r[0] == "late"]
    assert {r[1:3] for r in got if r[0] == "stalled"} >= {(r.analysis_id, r.event_id) for r in batch if r.seconds > 3600 and r.status not in ("complete", "failed")}


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    """Waiting events and timers survive a stop: two runs over one checkpoint tell the same as one."""
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    folder.mkdir()
    first = [[("A", 0, "cloning")], [("A", 500, "building_index"), ("B", 300, "cloning")]]
    arrive(folder, first)
    for batches in (None, [*first, [("B", 9000, "complete"), ("A", 450, "cloning")], [("C", 30_000, "cloning")]]):
        if batches:
            arrive(folder, batches)
        stream = stage_events_stream(progress_stream(spark, str(folder), 1))
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(check)).trigger(availableNow=True).start(str(out))
        run.awaitTermination()
    got = sorted((r.kind, r.analysis_id, r.event_id, r.seconds) for r in spark.read.schema(stream.schema).parquet(str(out)).collect())
    assert got == [("stage", "A", 0, 450), ("stage", "A", 4, 50), ("stage", "B", 2, 8700), ("stalled", "A", 1, 3600), ("stalled", "B", 2, 3600)]


def test_a_stage_asks_little_of_its_state():
    """Each call of state or timers is a message to the JVM; a steady analysis needs six at most, and gives rows."""
    from corpuslens.streaming.progress import StageClock
    from pyspark.sql import Row

    calls = []

    class State:
        held = None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("update", "put"):
                    self.held = given[0]
                elif name == "clear":
                    self.held = None
                elif name in ("registerTimer", "deleteTimer"):
                    return None
                return self.held if name == "get" else None
            return call

    class Handle(State):
        def getListState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

    class Times:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    clock = StageClock(("complete",), 3600, 7200)
    clock.init(Handle())
    given = [Row(event_id=k, status="s", at=k * 60_000_000) for k in (2, 1)]
    assert list(clock.handleInputRows(("a",), iter(given), Times(0))) == [] and len(calls) <= 6
    calls.clear()
    told = list(clock.handleExpiredTimer(("a",), Times(120_001), None))
    assert [tuple(r) for r in told] == [("a", 1, "s", 60, "stage")] and len(calls) <= 6
    late = list(clock.handleInputRows(("a",), iter(given[:1]), Times(120_001)))
    assert [r.kind for r in late] == ["late"]
