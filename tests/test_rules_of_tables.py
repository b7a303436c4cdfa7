"""Doubled keys, recordings without speech, and locks of killed runs."""

import os
import time

import pytest

from intervale.operators import validate
from intervale.plans import runner


def test_doubled_keys(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    table = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    with pytest.raises(Exception, match="more than one thing for 1"):
        validate.lookup(rows, table, ["k"], ["v"], "thing").collect()
    assert [r.v for r in validate.lookup(rows.where("k = 2"), table, ["k"], ["v"], "thing").collect()] == ["c"]
    assert sorted((r.k, r.v) for r in validate.lookup(rows, table, ["k"], ["v"], "thing", last_by="n").collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="no thing for 2"):
        validate.lookup(rows, table.where("k = 1"), ["k"], ["v"], "thing", last_by="n").collect()


def test_recordings_without_speech(spark):
    segments = spark.createDataFrame([("a", 0, 1.0, 0.5, "x"), ("b", 0, 0.0, 1.0, "x")], "recording_id string, seq int, start double, stop double, text string")
    recordings = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "recording_id string")
    assert sorted(map(tuple, validate.speech_violations(segments, recordings).collect()), key=str) == [("a", 0, "interval"), ("c", None, "empty")]
    assert len(validate.speech_violations(segments).collect()) == 1


def test_locks_of_killed_runs_are_taken_over(spark, tmp_path):
    run, lock = f"file://{tmp_path}/run", tmp_path / "run" / ".lock"
    with runner.one_writer(spark, run, stale_after=2.0):
        time.sleep(3.0)  # longer than that, but touched
        with pytest.raises(runner.Busy), runner.one_writer(spark, run, stale_after=2.0):
            pass
        assert lock.exists()
    assert not lock.exists()
    lock.write_text("0" * 32)  # a run that was killed
    with pytest.raises(runner.Busy), runner.one_writer(spark, run):
        pass
    old = time.time() - 3600
    os.utime(lock, (old, old))
    with runner.one_writer(spark, run):
        assert lock.read_text() != "0" * 32
    assert [p.name for p in (tmp_path / "run").iterdir() if not p.name.endswith(".crc")] == []
