"""Interval operators against plain definitions, and the golden cases of the domain."""

import random

from intervale.operators import intervals as iv

R = "rec"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def align_plainly(frames, segments, max_gap):
    out = {}
    for rec, frame, ts in frames:
        own = sorted((s for s in segments if s[0] == rec), key=lambda s: s[2])
        if not own:
            continue
        hit = next((s for s in own if s[3] <= ts < s[4]), None)
        if hit:
            out[rec, frame] = (hit[1], True)
            continue
        gap = lambda s: s[3] - ts if ts < s[3] else ts - s[4]
        best = min(own, key=lambda s: (gap(s), s[2]))
        out[rec, frame] = (best[1], gap(best) <= max_gap)
    return out


def test_align_golden(spark):
    segments = rows(spark, [(R, 0, 0, 0.0, 10.0), (R, 1, 1, 10.0, 20.0)], "recording_id string, segment_id long, seq long, start double, stop double")
    frames = rows(spark, [(R, 1, 1.0), (R, 2, 12.0), (R, 3, 25.0), (R, 4, 20.0), (R, 5, 10.0)], "recording_id string, frame_id long, ts double")
    got = {r.frame_id: (r.segment_id, r.has_audio_context) for r in iv.align(frames, segments, max_gap=3.0, width=7.0).collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (1, False), 4: (1, True), 5: (1, True)}


def test_align_random_with_overlaps_and_ties(spark):
    rng = random.Random(5)
    segments = []
    for rec in "abc":
        for i in range(12):
            start = rng.randrange(0, 120)
            segments.append((rec, i + 100, i, start, start + rng.randrange(1, 15)))
    frames = [(rec, i, rng.randrange(-10, 160)) for rec in "abcd" for i in range(60)]
    got = iv.align(rows(spark, frames, "recording_id string, frame_id long, ts long"), rows(spark, segments, "recording_id string, segment_id long, seq long, start long, stop long"), max_gap=3, width=10)
    assert {(r.recording_id, r.frame_id): (r.segment_id, r.has_audio_context) for r in got.collect()} == align_plainly(frames, segments, 3)


def test_overlap_slots_random(spark):
    rng = random.Random(6)
    blocks = [("r", i, (s := rng.randrange(100)), s + rng.randrange(0, 20)) for i in range(30)]
    visuals = [("r", i, (s := rng.randrange(100)), s + rng.randrange(0, 20)) for i in range(30)]
    got = iv.overlap_slots(rows(spark, blocks, "recording_id string, block_id long, start long, stop long"), rows(spark, visuals, "recording_id string, ord long, v_start long, v_stop long"), width=8)
    want = {(b[1], v[1], max(b[2], v[2]), min(b[3], v[3])) for b in blocks for v in visuals if max(b[2], v[2]) < min(b[3], v[3])}
    found = [(r.block_id, r.ord, r.slot_start, r.slot_stop) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_nested_blocks_keep_those_without_visuals(spark):
    blocks = rows(spark, [("r", 0, 0, 10), ("r", 1, 10, 20)], "recording_id string, block_id long, start long, stop long")
    visuals = rows(spark, [("r", 7, 5, 10), ("r", 8, 1, 10)], "recording_id string, ord long, v_start long, v_stop long")
    got = {r.block_id: [v.ord for v in r.visuals] for r in iv.nest_slots(blocks, iv.overlap_slots(blocks, visuals, width=5), ["slot_stop"]).collect()}
    assert got == {0: [8, 7], 1: []}


def snap_one(value, candidates):
    return min(candidates, key=lambda c: (abs(c - value), -c))


def test_snap_golden_and_random(spark):
    rng = random.Random(7)
    candidates = sorted({rng.randrange(200) for _ in range(25)})
    bounds = [("r", i, rng.randrange(-20, 220)) for i in range(80)]
    got = iv.snap(rows(spark, bounds, "recording_id string, boundary_id long, value long"), rows(spark, [("r", c) for c in candidates], "recording_id string, value long"), warn_over=3, width=7)
    for r in got.collect():
        assert r.snapped == snap_one(r.value, candidates)
        assert r.warned == (abs(r.snapped - r.value) > 3)
    tie = iv.snap(rows(spark, [("r", 1, 5.0)], "recording_id string, boundary_id long, value double"), rows(spark, [("r", 0.0), ("r", 10.0)], "recording_id string, value double"), warn_over=0.2, width=4.0).first()
    assert tie.snapped == 10.0 and tie.warned


def test_slice_words_golden(spark):
    words = [("r", 0, 0, "ab", 0.0, 2.0), ("r", 0, 1, "cd", 2.0, 5.0), ("r", 0, 2, "ef", 5.0, 10.0), ("q", 0, 0, "a", 0.0, 0.0), ("q", 0, 1, "b", 1.0, 1.0), ("q", 0, 2, "c", 2.0, 2.0)]
    segments = [("r", 0, 0, 0.0, 10.0, "abcdef"), ("q", 0, 0, 0.0, 2.0, "abc"), ("p", 0, 0, 0.0, 4.0, " whole ")]
    markers = [("r", 0, 0.0, 5.0), ("r", 1, 5.0, 10.0), ("q", 0, 0.0, 1.5), ("p", 0, 1.0, 2.0), ("p", 1, 9.0, 10.0)]
    got = iv.slice_words(
        rows(spark, markers, "recording_id string, marker_id long, start double, stop double"),
        rows(spark, segments, "recording_id string, segment_id long, seq long, start double, stop double, text string"),
        rows(spark, words, "recording_id string, segment_id long, word_pos long, word string, start double, stop double"), width=3.0,
    )
    assert {(r.recording_id, r.marker_id): r.text for r in got.collect()} == {("r", 0): "abcd"[:4], ("r", 1): "ef", ("q", 0): "ab", ("p", 0): "whole", ("p", 1): ""}


def test_coverage(spark):
    marker_schema = "recording_id string, start double, stop double"
    markers = rows(spark, [("r", 0.0, 3.0), ("r", 7.0, 10.0)], marker_schema)
    words = rows(spark, [("r", 0, 0, "a", 0.0, 3.0), ("r", 0, 1, "b", 4.0, 6.0), ("r", 0, 2, " ", 4.0, 6.0), ("r", 0, 3, "c", 7.0, 10.0)], "recording_id string, segment_id long, word_pos long, word string, start double, stop double")
    assert [r.word for r in iv.uncovered_words(words, markers, width=4.0).collect()] == ["b"]
    lines = rows(spark, [("r", 0, 0.0, 10.0), ("r", 1, 0.0, 3.0)], "recording_id string, segment_id long, start double, stop double")
    assert [r.segment_id for r in iv.uncovered_lines(lines, markers, width=4.0).collect()] == [0]
    touching = rows(spark, [("r", 0.0, 5.0), ("r", 5.0, 10.0)], marker_schema)
    assert iv.uncovered_lines(lines, touching, width=4.0).count() == 0


def test_block_chapters_later_wins(spark):
    chapters = rows(spark, [("r", 1, 0, 0, 2), ("r", 2, 1, 2, 3)], "recording_id string, chapter_id long, seq long, block_id_start long, block_id_end long")
    assert {r.block_id: r.chapter_id for r in iv.block_chapters(chapters).collect()} == {0: 1, 1: 1, 2: 2, 3: 2}
