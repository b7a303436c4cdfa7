"""Frames to the nearest segments from streams, against the batch operator and against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from intervale.operators import intervals
from intervale.streaming import events

SECOND = 1_000_000


def nearest_of_all(t, segments):
    inside = [s for s in segments if s[2] <= t < s[3]]
    if inside:
        return -1, min(inside, key=lambda s: s[1])[0]
    gaps = [(s[2] - t if s[2] > t else t - s[3], s[1], s[0]) for s in segments]
    return (min(gaps)[0], min(gaps)[2]) if gaps else (None, None)


@pytest.mark.parametrize("seed", range(40))
def test_one_sweep_finds_what_all_pairs_find(seed):
    rng = random.Random(seed)
    starts = [rng.randrange(60) for _ in range(rng.randrange(12))]
    segments = [(100 + n, n, s, s + rng.randrange(9)) for n, s in enumerate(starts)]
    frames = [(rng.randrange(-5, 75), i) for i in range(30)]
    got = list(events.nearest_in_order(frames, segments))
    assert [(t, i) for t, i, _, _ in got] == sorted(frames)
    assert all((g, s) == nearest_of_all(t, segments) for t, _, g, s in got)
    # what is let go of changes nothing for later frames
    since = rng.randrange(70)
    later = [(t, i) for t, i in frames if t >= since]
    assert list(events.nearest_in_order(later, events.live_segments(segments, since))) == [x for x in got if x[0] >= since]


def run(spark, parts, folder, **more):
    told = []
    for rows in parts:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = events.nearest_stream(spark.readStream.schema(events.MARKS).parquet(f"{folder}/in"), **more)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        told.append(spark.read.schema("recording_id string, frame_id long, ts long, segment_id long, has_audio_context boolean").parquet(f"{folder}/out").collect())
    return told


def end(spark, second):
    return spark.range(1).select(F.lit("end").alias("kind"), events.event_time(F.lit(second * SECOND)).alias("at"))


def test_any_order_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(5)
    segments = [(r, n, n, s * SECOND, (s + rng.randrange(1, 12)) * SECOND) for r in "ab" for n, s in enumerate(rng.sample(range(200), 12))]
    frames = [(r, i, rng.randrange(210) * SECOND) for r in "abc" for i in range(60)]  # c has no segment
    f = spark.createDataFrame(frames, "recording_id string, frame_id long, ts long")
    s = spark.createDataFrame(segments, "recording_id string, segment_id long, seq long, start long, stop long")
    want = sorted(map(tuple, intervals.align(f, s, max_gap=3 * SECOND, width=10 * SECOND).collect()))
    rows = events.marks(f, s).collect()
    rng.shuffle(rows)
    parts = [spark.createDataFrame(rows[i::3], events.MARKS) for i in range(3)]
    *early, got = run(spark, [*parts, end(spark, 10_000)], tmp_path, max_gap=3 * SECOND, late="300 seconds")
    assert sorted(map(tuple, got)) == want and len(want) == 120
    assert early[-1] == []  # nothing is told before it is sure


def test_frames_go_out_when_nothing_nearer_can_come(spark, tmp_path):
    mark = lambda kind, i, start, stop=None: ("r", kind, i, i if stop is not None else None, start * SECOND, None if stop is None else stop * SECOND)
    made = lambda *rows: spark.createDataFrame(rows, events.MARKS.removesuffix(", at timestamp")).withColumn("at", events.event_time(F.col("start")))
    broken = ("r", "segment", 9, None, 1, None)
    parts = [
        made(mark("segment", 0, 0, 10), mark("frame", 1, 5), mark("frame", 2, 18), mark("frame", 3, 30), broken),  # watermark 20: frame 1 is sure, frame 2 (gap 8) until 26
        made(mark("segment", 1, 21, 24), mark("frame", 4, 41)),  # 31: frame 2 is nearer to the later one, frame 3 (gap 6) until 36
        made(mark("frame", 5, 52)),  # 42: frame 3; frame 4 (gap 17) until 58
        made(mark("segment", 2, 12, 19)),  # too late, left out
        end(spark, 200),
    ]
    told = run(spark, parts, tmp_path, max_gap=4 * SECOND, late="10 seconds")
    assert [sorted((r.frame_id, r.segment_id, r.has_audio_context) for r in x) for x in told] == [
        [(1, 0, True)], [(1, 0, True), (2, 1, True)], [(1, 0, True), (2, 1, True), (3, 1, False)], [(1, 0, True), (2, 1, True), (3, 1, False)],
        [(1, 0, True), (2, 1, True), (3, 1, False), (4, 1, False), (5, 1, False)],
    ]
