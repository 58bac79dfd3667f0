"""Streams over several files: batches add up, repeated runs don't, and an empty folder gives no rows."""

import datetime
import glob
import shutil
import uuid

from pyspark.sql import functions as F

from graphloom.streaming import progress as R


def events(spark, folder, days):
    for i, day in enumerate(days):
        ts = datetime.datetime(2024, 1, day, 10)
        rows = [(10 * i + k, ts + datetime.timedelta(minutes=k), k % 2, "view", float(k), "{}") for k in range(4)]
        spark.createDataFrame(rows, R.SCHEMA).coalesce(1).write.parquet(f"{folder}/x{i}")
        shutil.move(glob.glob(f"{folder}/x{i}/part-*.parquet")[0], f"{folder}/events{i}.parquet")
        shutil.rmtree(f"{folder}/x{i}")


def test_updates_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    events(spark, str(src), [1, 1, 2])
    out = str(tmp_path / uuid.uuid4().hex)
    got = R.run(R.tumbling(R.source(spark, str(src)), size="1 day"), out, "update", ("start", "event_type"))
    assert sorted((r["n"], r["total"]) for r in got.collect()) == [(4, 6.0), (8, 12.0)]
    again = R.run(R.tumbling(R.source(spark, str(src)), size="1 day"), out, "update", ("start", "event_type"))
    assert again.count() == 2


def test_latest_and_complete(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    events(spark, str(src), [1, 3, 2])
    got = R.run(R.latest(R.source(spark, str(src))), str(tmp_path / "latest"), "update", ("user_id",))
    assert {r["user_id"]: r["ts"].day for r in got.collect()} == {0: 3, 1: 3}
    got = R.run(R.sessions(R.source(spark, str(src)), late="5 days"), str(tmp_path / "sessions"), "complete")
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(0, 2)] * 3 + [(1, 2)] * 3


def test_empty_folder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    got = R.run(R.once(R.source(spark, str(src))), str(tmp_path / "once"))
    assert got.count() == 0 and got.columns[0] == "event_id"
    assert got.select(F.count("*")).first()[0] == 0
