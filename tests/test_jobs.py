"""The stateful stream of jobs: over batches and a restart as over all at once, with its state freed."""

import datetime
import glob
import shutil
import types

from pyspark.sql import Row

from graphloom.streaming import jobs as J
from graphloom.streaming import progress as R

DAY = datetime.datetime(2024, 1, 1)


def put(spark, folder, number, rows):
    """rows: (event id, hours since the first day, job, stage)."""
    data = [(e, DAY + datetime.timedelta(hours=h), job, stage, 0.0, "{}") for e, h, job, stage in rows]
    spark.createDataFrame(data, R.SCHEMA).coalesce(1).write.parquet(f"{folder}/x{number}")
    shutil.move(glob.glob(f"{folder}/x{number}/part-*.parquet")[0], f"{folder}/events{number}.parquet")
    shutil.rmtree(f"{folder}/x{number}")


def rows(df):
    hours = lambda t: (t - DAY).total_seconds() / 3600
    return sorted((r["job_id"], hours(r["started"]), hours(r["last"]), r["files"], r["final_files"], r["state"]) for r in df.collect())


def test_jobs_end_over_batches_and_a_restart(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put(spark, src, 0, [(1, 0, 1, "view"), (2, 1, 1, "purchase"), (3, 0, 2, "view")])
    put(spark, src, 1, [(11, 2, 1, "error"), (3, 1, 2, "click"), (5, 20, 2, "signup")])  # job 2 starts anew in the same batch
    got = rows(J.run(spark, R.source(spark, str(src)), out))
    assert got == [(1, 0.0, 2.0, 2, 2, "active"), (2, 0.0, 1.0, 1, 0, "stale"), (2, 20.0, 20.0, 1, 1, "active")]
    put(spark, src, 2, [(7, 60, 3, "view")])  # the watermark passes job 1 and the second run of job 2
    put(spark, src, 3, [(8, 61, 3, "signup")])
    got = rows(J.run(spark, R.source(spark, str(src)), out))
    want = [(1, 0.0, 2.0, 2, 2, "finished"), (2, 0.0, 1.0, 1, 0, "stale"), (2, 20.0, 20.0, 1, 1, "finished"), (3, 60.0, 61.0, 2, 1, "active")]
    assert got == want
    state = spark.read.format("statestore").option("path", f"{out}/progress").option("stateVarName", "times").load()
    assert [r["key"]["job_id"] for r in state.select("key").collect()] == [3]  # all else is freed
    assert rows(J.run(spark, R.source(spark, str(src), files_per_batch=10), str(tmp_path / "once"))) == want
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


class State:
    """A state of a job that counts the messages sent for it."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "put"):
                self.held = args[0]
            return self.held if name == "get" and self.held is not None else iter(()) if name == "iterator" else None if name == "get" else False

        return call


def test_messages_to_the_state_do_not_grow_with_the_events_of_a_job():
    counts = []
    for n in (2, 200):
        calls = []
        handle = types.SimpleNamespace(registerTimer=calls.append, deleteTimer=calls.append, listTimers=lambda: calls.append("listTimers") or iter(()))
        handle.getValueState = handle.getMapState = handle.getListState = lambda *_: State(calls)  # noqa: B023
        job = J.Jobs(6 * 3_600_000)
        job.init(handle)
        events = [Row(file_name=f"file_{i % 10}", event_type="view", event_id=i, ms=i) for i in range(n)]
        try:
            list(job.handleInputRows((1,), iter(events), None))
        except TypeError:  # a state that forgets what it is told is no matter here
            pass
        counts.append(len(calls))
    assert counts[0] == counts[1] <= 6  # F33
