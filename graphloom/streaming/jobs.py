"""Job progress as a stream with state of its own: a job's files and their last status, until the job ends.

A job runs from its first event until it has been silent for `gap`, in the events' time.
Then it is finished if every file's last status is final, else stale. Its state is a row
per file and its two times, read and written once in a batch that brings events of it; a
timer, moved with them, frees all of it. Until then
each batch that brings events gives the job as active. An event after the gap begins
another run of the job.
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from graphloom.streaming import progress as R

#: Statuses that end a file (fixed values).
FINAL = ("purchase", "error", "signup")
STATUS = "job_id long, started long, last long, files long, final_files long, state string"
KEYS = ("job_id", "started")
#: States with timers are kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class Jobs(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getListState("files", "file string, stage string, ms long, event_id long")
        self.times = handle.getValueState("times", "started long, last long")

    @staticmethod
    def _status(key, started: int, last: int, files: dict, state: str) -> Row:
        final = sum(stage in FINAL for stage, _, _ in files.values())
        if state == "ended":
            state = "finished" if final == len(files) else "stale"
        return Row(job_id=key[0], started=started, last=last, files=len(files), final_files=final, state=state)

    def _known(self) -> tuple[tuple | None, dict]:
        """A job's state: its times, None without any, and its files. Every call to the state is a message to another process."""
        times = self.times.get()
        return times, {f: (stage, ms, n) for f, stage, ms, n in self.files.get()} if times else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before, files = self._known()
        times = before
        for ms, event_id, file, stage in sorted(((r.ms, r.event_id, r.file_name, r.event_type) for r in rows), key=lambda r: r[:2]):
            if times and ms - times[1] >= self.gap:
                yield self._status(key, *times, files, "ended")
                times, files = None, {}
            times = (min(times[0], ms), max(times[1], ms)) if times else (ms, ms)
            known = files.get(file)
            if known is None or known[1:] < (ms, event_id):
                files[file] = (stage, ms, event_id)
        self.times.update(times)
        self.files.put([(f, *v) for f, v in files.items()])
        if not before or before[1] != times[1]:  # a job has one timer
            if before:
                self.handle.deleteTimer(before[1] + self.gap)
            self.handle.registerTimer(times[1] + self.gap)
        yield self._status(key, *times, files, "active")

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        times, files = self._known()
        if times:
            self.files.clear()
            self.times.clear()
            yield self._status(key, *times, files, "ended")

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _store(spark: SparkSession):
    """The state store that timers need, for the queries started within."""
    old = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, STORE)
    try:
        yield
    finally:
        spark.conf.set(_SETTING, old)


def jobs(events: DataFrame, gap: datetime.timedelta = datetime.timedelta(hours=6), late: str = "1 day") -> DataFrame:
    """STATUS rows, with times as timestamps, of the jobs (users) of a stream of events, in update mode; a file is an event id in tens."""
    rows = events.withWatermark("ts", late).select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("file_"), (F.col("event_id") % 10).cast("string")).alias("file_name"), "event_type", "event_id", "ts", F.unix_millis("ts").alias("ms")
    )
    status = rows.groupBy("job_id").transformWithState(Jobs(int(gap.total_seconds() * 1000)), STATUS, "Update", "EventTime")
    return status.withColumns({c: F.timestamp_millis(c) for c in ("started", "last")})


def run(spark: SparkSession, events: DataFrame, folder: str, **options) -> DataFrame:
    """Work off what is there and return the last status of each run of each job."""
    with _store(spark):
        return R.run(jobs(events, **options), folder, "update", KEYS)
