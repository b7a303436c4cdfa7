"""The same operators on streams: alignment to known segments, window usage, and live admission."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from intervale.operators.admission import Limiter
from intervale.operators.intervals import KEY, holds_point


def align_stream(frames: DataFrame, segments: DataFrame, *, width: int) -> DataFrame:
    """Arriving frames (recording_id, frame_id, ts) within their segments, a stream-static join on time buckets.

    Half-open intervals; frames outside every segment are left out, since the
    nearest one is only known once later segments are.
    """
    spans = segments.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("stop") / width).cast("long"))))
    points = frames.withColumn("_bucket", F.floor(F.col("ts") / width).cast("long"))
    return points.join(spans.select(KEY, "_bucket", "segment_id", "start", "stop"), [KEY, "_bucket"]).where(holds_point(F.col("start"), F.col("stop"), F.col("ts"))).select(KEY, "frame_id", "ts", "segment_id")


def usage_stream(requests: DataFrame, *, window: str, late: str) -> DataFrame:
    """Requests (profile, at timestamp, tokens) counted by event-time window, with a watermark for late ones."""
    return requests.withWatermark("at", late).groupBy("profile", F.window("at", window).alias("w")).agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens")
    ).select("profile", F.col("w.start").alias("window_start"), "requests", "tokens")


def admission_stream(requests: DataFrame, *, rpm: int | None, tpm: int | None) -> DataFrame:
    """Requests (profile, seq, t seconds, tokens) with the time at which each may go out.

    A profile's log of its last window is state, so the limit holds over all
    tasks: one key, one writer.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter, clock = Limiter(rpm, tpm), float("-inf")
        if state.exists:
            clock, times, tokens = state.get
            for t, n in zip(times, tokens, strict=True):
                limiter.note(t, n)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for t, n in zip(rows["t"], rows["tokens"], strict=True):
            clock = limiter.admit(max(clock, t), int(n))
            out.append(clock)
        state.update((clock, [t for t, _ in limiter.log], [n for _, n in limiter.log]))
        yield pd.DataFrame({"profile": key[0], "seq": rows["seq"], "admitted": out})

    return requests.groupBy("profile").applyInPandasWithState(
        admit, "profile string, seq long, admitted double", "clock double, times array<double>, tokens array<long>", "append", GroupStateTimeout.NoTimeout
    )


#: What a stream of marks may hold: a frame, a segment, or neither, which only lets time go on.
MARKS = "recording_id string, kind string, id long, seq long, start long, stop long, at timestamp"
#: Microseconds by which event times are ahead: a watermark starts at 0, and what isn't past it counts as late.
_AHEAD = 10**15
_LIVE = "frame_ids array<long>, times array<long>, segment_ids array<long>, seqs array<long>, starts array<long>, stops array<long>"


def event_time(us: Column) -> Column:
    """The event time ``at`` of a mark at so many microseconds, which may be from zero, or some 30 years less, on."""
    return F.timestamp_micros(us + _AHEAD)


def marks(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames (recording_id, frame_id, ts) and segments (recording_id, segment_id, seq, start, stop), in whole microseconds, as one table of marks."""
    absent = F.lit(None).cast("long")
    a = frames.select(F.col(KEY).cast("string"), F.lit("frame").alias("kind"), F.col("frame_id").cast("long").alias("id"), absent.alias("seq"), F.col("ts").cast("long").alias("start"), absent.alias("stop"))
    b = segments.select(F.col(KEY).cast("string"), F.lit("segment").alias("kind"), F.col("segment_id").cast("long").alias("id"), F.col("seq").cast("long"), F.col("start").cast("long"), F.col("stop").cast("long"))
    return a.unionByName(b).withColumn("at", event_time(F.col("start")))


def nearest_stream(arriving: DataFrame, *, max_gap: int, late: str) -> DataFrame:
    """A stream of marks -> (recording_id, frame_id, ts, segment_id, has_audio_context), each frame once, as ``intervals.align`` has it.

    Frames and segments come in any order, up to ``late`` behind the latest start of
    any mark; a segment that is known when it ends needs that to take in its length.
    What comes later still is left out.  A frame goes out when the watermark is past
    its segment's end of the gap: no segment that is still to come can be as near.
    Frames of a recording without any segment stay; a mark of another kind, with
    an ``event_time`` past all others, lets the last ones go.  Marks without a time, or segments
    without an end, are left out.

    A recording is one key.  Its state is its live part: frames that wait, segments
    that such a frame or a later one can meet, and of those that ended before
    the one that ended last.
    """

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, known = [], []
        if state.exists:
            frame_ids, times, *spans = state.get
            waiting, known = list(zip(times, frame_ids, strict=True)), list(zip(*spans, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += rows.loc[rows["kind"] == "frame", ["start", "id"]].itertuples(index=False, name=None)
                known += rows.loc[rows["kind"] == "segment", ["id", "seq", "start", "stop"]].itertuples(index=False, name=None)
        now = state.getCurrentWatermarkMs() * 1000 - _AHEAD
        done, left, due = [], [], None
        for t, frame, gap, segment in nearest_in_order(waiting, known):
            sure = None if gap is None else t + max(gap, 0)
            if sure is not None and sure <= now:
                done.append((key[0], frame, t, segment, gap <= max_gap))
            else:
                left.append((t, frame))
                due = min((x for x in (due, sure) if x is not None), default=None)
        known = live_segments(known, min([now, *(t for t, _ in left)]))
        if left or known:
            ids, seqs, starts, stops = (list(map(int, x)) for x in (zip(*known, strict=True) if known else ([],) * 4))
            state.update(([int(i) for _, i in left], [int(t) for t, _ in left], ids, seqs, starts, stops))
            if due is not None:
                state.setTimeoutTimestamp(max(-(-(int(due) + _AHEAD) // 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=[KEY, "frame_id", "ts", "segment_id", "has_audio_context"])

    # No filter: one would go below the watermark, and marks that only let time go on would be gone.
    complete = F.col("start").isNotNull() & F.col("id").isNotNull() & ((F.col("kind") == "frame") | (F.col("seq").isNotNull() & F.col("stop").isNotNull()))
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("id", "seq", "start", "stop")]
    return arriving.withWatermark("at", late).select(KEY, F.when(complete, F.col("kind")).otherwise("").alias("kind"), *numbers, "at").groupBy(KEY).applyInPandasWithState(
        settle, f"{KEY} string, frame_id long, ts long, segment_id long, has_audio_context boolean", _LIVE, "append", GroupStateTimeout.EventTimeTimeout
    )


def nearest_in_order(frames: list[tuple[int, int]], segments: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int | None, int | None]]:
    """frames (t, id) in time order, each with its gap, -1 within a segment, and segment; one sweep over (id, seq, start, stop)."""
    coming = sorted(segments, key=lambda s: (s[2], s[1], s[0]))
    begun: list[tuple[int, int, int]] = []  # by place in the list
    last, i = None, 0  # of those begun: latest end, first in the list
    for t, frame in sorted(frames):
        while i < len(coming) and coming[i][2] <= t:
            segment, seq, _, stop = coming[i]
            heapq.heappush(begun, (seq, segment, stop))
            last = max(last, (stop, -seq, segment)) if last else (stop, -seq, segment)
            i += 1
        while begun and begun[0][2] <= t:
            heapq.heappop(begun)
        if begun:
            yield t, frame, -1, begun[0][1]
            continue
        near = [(t - last[0], -last[1], last[2])] if last else []
        near += [(coming[i][2] - t, coming[i][1], coming[i][0])] if i < len(coming) else []
        gap, _, segment = min(near, default=(None, None, None))
        yield t, frame, gap, segment


def live_segments(segments: list[tuple[int, int, int, int]], since: int) -> list[tuple[int, int, int, int]]:
    """Those that a frame at ``since`` or later can meet: all that reach past it, and the one that ended last."""
    over = [s for s in segments if max(s[2], s[3]) <= since]
    return [s for s in segments if max(s[2], s[3]) > since] + ([max(over, key=lambda s: (s[3], -s[1], s[0]))] if over else [])
