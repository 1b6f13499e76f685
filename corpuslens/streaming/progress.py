"""Progress events as a stream. The checkpoint of a query is its read offset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from corpuslens.operators.progress import TTL_SECONDS, session_state

EVENT = "analysis_id string, event_id bigint, status string, progress_percent int, error_message string, ts timestamp"


def parse_events(lines: DataFrame) -> DataFrame:
    """JSON text to events; text that is no JSON object is passed over."""
    return lines.select(F.from_json("value", EVENT).alias("_e")).where(
        F.col("_e").isNotNull() & F.col("_e.analysis_id").isNotNull()
    ).select("_e.*")


def progress_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Events appended as JSON lines to files below ``folder``.

    The files per trigger bound a micro-batch, and with it what one key can bring to a stateful task at once.
    """
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_events(reader.load(folder))


def latest_status_stream(events: DataFrame, keep: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Current status per analysis; write it in update mode and let the newest ``ts`` of an analysis win.

    State is one event per analysis and span of ``keep``, dropped once the watermark has passed the span.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("analysis_id", F.window("ts", keep))
        .agg(F.max(F.struct("ts", "event_id", "status", "progress_percent", "error_message")).alias("_e"))
        .select("analysis_id", "_e.status", "_e.progress_percent", "_e.error_message", "_e.ts")
    )


def progress_sessions_stream(events: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Lists that expired, with how they ended; write it in append mode."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("analysis_id", F.session_window("ts", f"{ttl_seconds} seconds").alias("_w"))
        .agg(
            F.count("*").alias("events"),
            F.max("progress_percent").alias("max_percent"),
            F.max((F.col("progress_percent") >= 100).cast("int")).alias("_complete"),
            F.max((F.col("status") == "failed").cast("int")).alias("_failed"),
        )
        .select(
            "analysis_id",
            F.col("_w.start").alias("session_start"),
            F.col("_w.end").alias("expires_at"),
            "events", "max_percent",
            session_state(F.col("_complete") == 1, F.col("_failed") == 1).alias("state"),
        )
    )


STAGE = "analysis_id string, event_id bigint, status string, seconds bigint, kind string"
#: Times are microseconds, so that no task turns them into objects.
PENDING = "event_id bigint, status string, at bigint"
#: The last event, if there is one (``at``), the moment of the timer, and whether events wait.
LAST = "event_id bigint, status string, at bigint, told boolean, timer bigint, waits boolean"

#: Statuses after which an analysis pushes nothing more.
ENDED = ("complete", "failed")
KEEP_SECONDS = 30 * 24 * 3600
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StageClock(StatefulProcessor):
    """Events of one analysis in the order of their time, whatever the order they arrive in.

    An event waits in a list until the watermark has passed it, so that none before it can still come; then it ends the
    stage of the event before it. A timer stands at the next moment at which something may be due: the first waiting event,
    a silence that is long enough to be told, or the end of what is kept.
    """

    def __init__(self, ended: tuple[str, ...], quiet_seconds: int, keep_seconds: int):
        self.ended, self.quiet_seconds, self.quiet, self.keep = ended, quiet_seconds, quiet_seconds * 1_000_000, keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PENDING)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh: list[tuple] = []
        for row in rows:
            event = (row["event_id"], row["status"], row["at"])
            if _passed(event[2], mark):
                yield Row(analysis_id=key[0], event_id=event[0], status=event[1], seconds=None, kind="late")
            else:
                fresh.append(event)
        yield from self._advance(key, fresh, mark)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, fresh: list[tuple], mark: int) -> list[Row]:
        """Each call of state is a message to the JVM: nothing is asked for or put that the last event does not tell."""
        found = self.last.get()
        last, timer, waited = (tuple(found[:4]) if found[2] is not None else None, found[4], found[5]) if found is not None else (None, None, False)
        waiting = [*(tuple(r) for r in self.waiting.get()), *fresh] if waited else fresh
        waiting.sort(key=lambda e: (e[2], e[0] if e[0] is not None else -1, e[1] or ""))
        out: list[Row] = []

        def tell(event: tuple, seconds: int, kind: str) -> None:
            out.append(Row(analysis_id=key[0], event_id=event[0], status=event[1], seconds=seconds, kind=kind))

        due = next((i for i, e in enumerate(waiting) if not _passed(e[2], mark)), len(waiting))
        for event in waiting[:due]:
            if last is not None:
                gap = event[2] - last[2]
                if gap > self.quiet and last[1] not in self.ended and not last[3]:
                    tell(last, self.quiet_seconds, "stalled")
                if gap <= (self.quiet if last[1] in self.ended else self.keep):
                    tell(last, gap // 1_000_000, "stage")
            last = (*event, False)
        if last is not None:
            done = last[1] in self.ended
            if not done and not last[3] and _passed(last[2] + self.quiet, mark):
                tell(last, self.quiet_seconds, "stalled")
                last = (*last[:3], True)
            end = last[2] + (self.quiet if done else self.keep)
            if _passed(end, mark):
                last = None
        waiting = waiting[due:]
        moments = [e[2] for e in waiting[:1]]
        if last is not None:
            moments.append(end if done or last[3] else last[2] + self.quiet)
        if waiting and (fresh or due):
            self.waiting.put(waiting)
        elif waited and not waiting:
            self.waiting.clear()
        # The first watermark that has passed the moment.
        moment = max(min(moments) // 1000 + 1, mark + 1) if moments else None
        if timer != moment:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if moment is not None:
                self.handle.registerTimer(moment)
        if moment is None:
            self.last.clear()
        else:
            self.last.update((*(last or (None, None, None, None)), moment, bool(waiting)))
        return out


def _passed(at: int, mark: int) -> bool:
    """Whether a watermark in milliseconds has passed a time in microseconds; what is exactly at it may still have company."""
    return at < mark * 1000


def stage_events_stream(
    events: DataFrame, ended: tuple[str, ...] = ENDED, quiet_seconds: int = TTL_SECONDS, keep_seconds: int = KEEP_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """What becomes known of stages, in append mode; ``kind`` tells what a row is.

    - ``stage``: the event's stage ended with the next event, after ``seconds``. It is told once the watermark has passed
      that next event, so the order of arrival within ``delay`` does not matter.
    - ``stalled``: nothing followed for ``quiet_seconds``, and the status is not one of ``ended``. Told once per event.
    - ``late``: the event came after the watermark had passed its time; it takes part in nothing.

    State is the waiting events of the last ``delay`` and one event per analysis, which is dropped ``quiet_seconds`` after an
    ended status and ``keep_seconds`` after any other; an event after that opens a new run. State needs RocksDB as the store
    (``spark.sql.streaming.stateStore.providerClass``), which is set here if the session leaves it at its default.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in (conf.get(name, None) or "HDFSBackedStateStoreProvider"):
        conf.set(name, ROCKS_DB)
    # The copy of the time carries no watermark, so that late events reach the processor instead of being dropped.
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        "analysis_id", "event_id", "status", F.unix_micros("ts").alias("at")
    )
    # Rows, not frames: an analysis has few events in a micro-batch, and a frame costs more than they do.
    return rows.groupBy("analysis_id").transformWithState(
        StageClock(ended, quiet_seconds, keep_seconds), STAGE, outputMode="Append", timeMode="EventTime"
    )


def stage_durations_stream(
    events: DataFrame, ended: tuple[str, ...] = ENDED, quiet_seconds: int = TTL_SECONDS, delay: str = "10 minutes", keep_seconds: int = KEEP_SECONDS
) -> DataFrame:
    """Seconds each stage took: the ``stage`` rows of ``stage_events_stream``."""
    told = stage_events_stream(events, ended, quiet_seconds, keep_seconds, delay)
    return told.where("kind = 'stage'").select("analysis_id", "event_id", "status", "seconds")
