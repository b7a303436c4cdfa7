"""Choosing rows: one of a group, a threshold, what passes a filter, and near-duplicate removal."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.operators.graphs import components

KEY = "recording_id"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def visible_length(text: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def representatives(judged: DataFrame) -> DataFrame:
    """The meaningful frame of each trimmed semantic key.

    judged (recording_id, frame_id, is_meaningful, semantic_key, quality_score,
    visible_text, sharpness).  The best by quality, then visible length, then
    sharpness; ties to the smallest frame id.  One aggregation, combined before
    the shuffle.
    """
    order = F.struct("quality_score", visible_length(F.col("visible_text")).alias("len"), "sharpness", (-F.col("frame_id")).alias("id"))
    return judged.where("is_meaningful").groupBy(KEY, trimmed(F.col("semantic_key")).alias("semantic_key")).agg(F.max_by("frame_id", order).alias("frame_id"))


def clamp_scenes(scenes: DataFrame, recordings: DataFrame, thresholds: list | None = None) -> DataFrame:
    """Scenes within [0, duration] of their recording, by threshold; [0, duration] where none is left.

    scenes (recording_id, threshold, start, stop), recordings (recording_id,
    duration).  Every recording has a row for every threshold given; without any
    given, for those that occur for the recording.
    """
    known = scenes.join(recordings, KEY)
    inside = known.select(KEY, "threshold", F.greatest("start", F.lit(0)).alias("start"), F.least("stop", "duration").alias("stop")).where("start < stop")
    if thresholds is None:
        wanted = known.select(KEY, "threshold", "duration").distinct()
    else:
        every = F.explode(F.array(*[F.lit(t).cast(scenes.schema["threshold"].dataType) for t in thresholds]))
        wanted = recordings.select(KEY, every.alias("threshold"), "duration")
    bare = wanted.join(inside.select(KEY, "threshold").distinct(), [KEY, "threshold"], "left_anti")
    zero = F.lit(0).cast(inside.schema["start"].dataType)
    return inside.unionByName(bare.select(KEY, "threshold", zero.alias("start"), F.col("duration").cast(inside.schema["stop"].dataType).alias("stop")))


def scene_threshold(counts: DataFrame, recordings: DataFrame, *, per_minute: float) -> DataFrame:
    """The threshold whose scene count is nearest to max(1, duration in minutes times per_minute).

    counts (recording_id, threshold, scenes), recordings (recording_id,
    duration in seconds).  The target rounds halves to even; ties go to fewer
    scenes, then to the higher threshold.
    """
    target = F.greatest(F.lit(1), F.bround(F.col("duration") / 60 * per_minute, 0).cast("long"))
    order = F.struct(F.abs(F.col("scenes") - F.col("target")), F.col("scenes"), -F.col("threshold"))
    return counts.join(recordings.withColumn("target", target), KEY).groupBy(KEY).agg(
        F.min_by("threshold", order).alias("threshold"), F.min_by("scenes", order).alias("scenes"), F.first("target").alias("target")
    )


def content_filter(frames: DataFrame, *, least: float) -> DataFrame:
    """Frames (recording_id, frame_id, score) with score >= least; the best one where a recording has none.

    Of equal best scores the first frame id stays.  The fallback comes from an
    aggregate a recording, so no recording has to fit one task.
    """
    best = frames.groupBy(KEY).agg(F.max("score").alias("best"), F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("best_frame"))
    return frames.join(best, KEY).where((F.col("score") >= least) | ((F.col("best") < least) & (F.col("frame_id") == F.col("best_frame")))).drop("best", "best_frame")


def best_frame(windows: DataFrame) -> DataFrame:
    """(recording_id, window_id, frame_id, ts, score) -> the best frame of each window; of equal scores the later."""
    order = F.struct("score", "ts", "frame_id")
    return windows.groupBy(KEY, "window_id").agg(F.max_by("frame_id", order).alias("frame_id"), F.max("score").alias("score"))


def distinct_times(frames: DataFrame, first_frames: DataFrame | None = None) -> DataFrame:
    """One frame a time of each recording, the first in scene order (``seq``).

    ``first_frames`` (recording_id, frame_id) stand in, at time 0, for recordings
    without any frame.
    """
    kept = frames.groupBy(KEY, "ts").agg(F.min_by("frame_id", "seq").alias("frame_id"), F.min("seq").alias("seq"))
    if first_frames is None:
        return kept
    bare = first_frames.join(frames.select(KEY).distinct(), KEY, "left_anti")
    zero = lambda c: F.lit(0).cast(kept.schema[c].dataType).alias(c)
    return kept.unionByName(bare.select(KEY, zero("ts"), F.col("frame_id").cast(kept.schema["frame_id"].dataType).alias("frame_id"), zero("seq")))


def change_scores(frames: DataFrame, *, block: int) -> DataFrame:
    """(recording_id, frame, ts, feature) -> (recording_id, frame, ts, score): how far each frame is from the one before.

    The score is the mean absolute difference of features; a recording's first
    frame has 0, and so has one whose neighbour has another size.  Frames are dealt to
    blocks of ``block`` numbers, and each block is lent the last frame of the
    block before it, so a recording is spread over tasks and only one frame a
    block travels twice.
    """
    rows = frames.select(KEY, "frame", "ts", "feature", F.floor(F.col("frame") / block).cast("long").alias("_block"))
    tails = rows.groupBy(KEY, "_block").agg(F.max_by(F.struct("frame", "feature"), "frame").alias("tail"))
    lent = tails.withColumn("tail", F.lag("tail").over(Window.partitionBy(KEY).orderBy("_block"))).where("tail is not null")
    lent = lent.select(KEY, "tail.frame", F.lit(None).cast(frames.schema["ts"].dataType).alias("ts"), "tail.feature", "_block", F.lit(True).alias("_lent"))
    before = F.lag("feature").over(Window.partitionBy(KEY, "_block").orderBy("frame"))
    joined = rows.withColumn("_lent", F.lit(False)).unionByName(lent).withColumn("_before", before).where("not _lent")
    score = F.when((F.size("_before") == F.size("feature")) & (F.size("feature") > 0), mean_difference(F.col("_before"), F.col("feature")))
    return joined.select(KEY, "frame", "ts", F.coalesce(score, F.lit(0.0)).alias("score"))


def scene_cuts(scores: DataFrame, *, thresholds: list[float], least_frames: int) -> DataFrame:
    """(recording_id, threshold, start, stop) of scenes between cuts, from the change scores of a recording's frames.

    scores (recording_id, frame, ts, score).  A frame whose score reaches the
    threshold starts a scene if the last one started ``least_frames`` frames ago
    or more; the first frame starts the first scene, the last frame's time ends
    the last one.  One fold over a recording's frames that reach the least
    threshold, which are few.
    """
    ends = scores.groupBy(KEY).agg(F.min_by("ts", "frame").alias("first_ts"), F.min("frame").alias("first"), F.max("ts").alias("last_ts"))
    high = scores.where(F.col("score") >= min(thresholds)).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "ts", "score"))).alias("high"))
    rows = ends.join(high, KEY, "left").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    start = F.array(F.struct(F.col("first").alias("frame"), F.col("first_ts").alias("ts")))
    step = lambda cuts, x: F.when(
        (x["score"] >= F.col("threshold")) & (x["frame"] - F.element_at(cuts, -1)["frame"] >= least_frames), F.array_append(cuts, F.struct(x["frame"].alias("frame"), x["ts"].alias("ts")))
    ).otherwise(cuts)
    cuts = rows.select(KEY, "threshold", "last_ts", F.aggregate(F.coalesce("high", F.array().cast(high.schema["high"].dataType)), start, step).alias("cuts"))
    scenes = F.transform("cuts", lambda c, i: F.struct(c["ts"].alias("start"), F.coalesce(F.get(F.col("cuts"), i + 1)["ts"], F.col("last_ts")).alias("stop")))
    return cuts.select(KEY, "threshold", F.explode(scenes).alias("s")).select(KEY, "threshold", "s.start", "s.stop").where("start < stop")


def frames_at(times: DataFrame, frames: DataFrame, *, fps: float) -> DataFrame:
    """times (recording_id, time_id, ts) plus the frame that a seek to ts shows: the first one not before it, if any.

    frames (recording_id, frame, ..) are numbered from 0 at a fixed rate, so the
    frame's number is known and the join is by equality.
    """
    return times.withColumn("frame", F.ceil(F.greatest("ts", F.lit(0.0)) * fps).cast("long")).join(frames, [KEY, "frame"], "left")


def candidate_times(windows: DataFrame, *, fps: float) -> DataFrame:
    """(recording_id, window_id, start, stop) plus ``times``: sampled, middle and last instants before the end.

    start, start + 1/fps and so on below stop, the middle and the largest double
    below stop; none is past that limit; distinct and ascending.
    """
    limit = _before(F.col("stop"))
    count = F.greatest(F.lit(0), F.ceil((F.col("stop") - F.col("start")) * fps)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), count), lambda i: F.col("start") + i / F.lit(fps))
    middle = F.col("start") + (F.col("stop") - F.col("start")) / 2
    rows = windows.withColumn("limit", limit)
    kept = F.filter(steps, lambda t: t < F.col("stop"))
    every = F.transform(F.concat(kept, F.array(middle, F.col("limit"))), lambda t: F.greatest(F.col("start"), F.least(t, F.col("limit"))))
    return rows.withColumn("times", F.array_sort(F.array_distinct(every))).drop("limit")


def _before(value: Column) -> Column:
    """The next double towards zero from a positive one, by halving the gap until it vanishes."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(value)) - 52)
    near = value - step / 2
    return F.when(near < value, near).otherwise(value - step)


def frame_times(scenes: DataFrame, *, representative: str) -> DataFrame:
    """(recording_id, seq, start, stop) plus ts: the ``middle`` or the ``last`` instant of each scene."""
    ts = F.col("start") + (F.col("stop") - F.col("start")) / 2 if representative == "middle" else _before(F.col("stop"))
    return scenes.withColumn("ts", ts)


# ---------------------------------------------------------------- near duplicates


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def greedy_dedupe(items: DataFrame, *, threshold: float, group: str = KEY) -> DataFrame:
    """What a greedy pass in ``seq`` order keeps of each group.

    items (group, seq, item_id, score, feature array).  Without a kept item
    nearer than the threshold, keep; else, if the score beats the best of those
    near ones, replace them all; else drop.  The pass depends on its own past
    and runs as one fold over a group's items; a group is one recording's
    frames, so its array is bounded by a recording.
    """
    item = F.struct("seq", "item_id", "score", F.col("feature").cast("array<double>").alias("feature"))
    gathered = items.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept: Column, x: Column) -> Column:
        is_near = lambda k: mean_difference(k["feature"], x["feature"]) < threshold
        near = F.filter(kept, is_near)
        best = F.array_max(F.transform(near, lambda k: k["score"]))
        rest = F.filter(kept, lambda k: ~is_near(k))
        return F.when(F.size(near) == 0, F.array_append(kept, x)).when(x["score"] > best, F.array_append(rest, x)).otherwise(kept)

    empty = F.array().cast(gathered.schema["items"].dataType)
    folded = gathered.select(group, F.explode(F.aggregate("items", empty, step)).alias("k"))
    return folded.select(group, "k.seq", "k.item_id", "k.score")


def spread_greedy(items: DataFrame, *, threshold: float, settle: Callable[[DataFrame], DataFrame], group: str = KEY, pivots: int = 3) -> DataFrame:
    """``greedy_dedupe`` for groups of any size: the same rows, from many tasks and without an array of a group.

    By the triangle inequality, items nearer than the threshold are so by their
    distances to a few pivots as well: a group's first item, the one farthest from it,
    and so on.  Cells of that width over these distances that touch are one
    region, and items of different regions never meet, so each region is
    folded on its own, as a stream in ``seq`` order that holds what is kept,
    by cell.  What is kept lies apart, so a cell holds little of it however many
    items pass through.  A region that is one cloud is one task.  Items without a
    feature, or with one that isn't finite, are near nothing and stay; those of
    different sizes are near nobody of the other size.  Ties in ``seq`` go by
    ``item_id``.
    """
    if threshold <= 0:  # nothing is nearer
        return items.select(group, "seq", "item_id", F.col("score").cast("double").alias("score"))
    feature = F.col("feature").cast("array<double>")
    able = F.coalesce((F.size(feature) > 0) & F.forall(feature, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    rows = items.select(group, "seq", "item_id", F.col("score").cast("double").alias("score"), feature.alias("feature"), F.size(feature).alias("_size"), able.alias("_able"))
    rows = rows.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))  # null is a group
    alone = rows.where("not _able").select(group, "seq", "item_id", "score")
    key = ["_group", "_size"]
    placed, axes = rows.where("_able").drop("_able"), []
    for i in range(pivots):
        far = F.max_by("feature", F.struct(F.least(F.lit(float("inf")), *axes), "seq", "item_id")) if axes else F.min_by("feature", F.struct("seq", "item_id"))
        pivot = placed.groupBy(*key).agg(far.alias("_pivot"))
        placed = settle(placed.join(pivot, key).withColumn(f"_d{i}", mean_difference(F.col("feature"), F.col("_pivot"))).drop("_pivot"))
        axes.append(f"_d{i}")
    # A little wider than the threshold, for what rounding may add to a distance.
    cell = F.array(*[F.floor(F.least(F.col(d) / (threshold * (1 + 1e-9)), F.lit(1e15))).cast("long") for d in axes])
    placed = placed.withColumn("cell", cell).withColumn("place", F.xxhash64(*key, "cell"))  # two cells of one hash share a region, which harms nothing
    cells = settle(placed.select(*key, "cell", "place").distinct())
    around = F.array(*[F.array(*[F.get("cell", F.lit(i)) + step for i, step in enumerate(steps)]) for steps in itertools.product((-1, 0, 1), repeat=pivots) if steps > (0,) * pivots])
    touching = cells.withColumn("beside", F.explode(around)).join(cells.select(*key, F.col("cell").alias("beside"), F.col("place").alias("b")), [*key, "beside"]).select(F.col("place").alias("a"), "b")
    roots = components(touching, settle=settle)
    placed = placed.join(roots, placed.place == roots.node, "left").withColumn("region", F.coalesce("root", "place")).drop("node", "root", "place", "_group", *axes)
    kind = T.StructType([placed.schema[c] for c in (group, "seq", "item_id", "score")])
    names = [f.name for f in kind.fields]

    def fold(batches):
        now, kept = None, None
        for batch in batches:
            regions = list(zip(batch.column("g").to_pylist(), batch.column("region").to_pylist(), batch.column("size").to_pylist(), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("g", "seq", "item_id", "score", "cell")]
            features = batch.column("feature")
            for i, region in enumerate(regions):
                if region != now:
                    if kept is not None:
                        yield kept.rows(kind)
                    now, kept = region, _Kept(threshold)
                g, seq, item_id, score, at = (c[i] for c in columns)
                kept.meet((g, seq, item_id, score), np.array(features[i].values), tuple(at))
        if kept is not None:
            yield kept.rows(kind)

    dealt = placed.select(F.col(group).alias("g"), "seq", "item_id", "score", "feature", "cell", F.col("_size").alias("size"), "region")
    folded = dealt.repartition("region").sortWithinPartitions("region", "g", "size", "seq", "item_id").mapInArrow(fold, kind)
    return folded.select(*names).unionByName(alone)


def _order(score: float) -> tuple[bool, float]:
    """NaN is larger than any number, as in Spark."""
    return (True, 0.0) if math.isnan(score) else (False, score)


class _Kept:
    """What a greedy pass has kept of a region so far, by cell."""

    def __init__(self, threshold: float):
        self.threshold, self.cells = threshold, {}

    def meet(self, row: tuple, feature: np.ndarray, cell: tuple[int, ...]) -> None:
        near = []
        for at in itertools.product(*[(c - 1, c, c + 1) for c in cell]):
            held = self.cells.get(at)
            if held:
                off = np.add.accumulate(np.abs(np.stack([f for _, f in held]) - feature), axis=1)[:, -1] / len(feature)
                near += [(at, held[i][0]) for i in np.flatnonzero(off < self.threshold)]
        best = max((_order(old[3]) for _, old in near if old[3] is not None), default=None)
        if near and (best is None or row[3] is None or _order(row[3]) <= best):  # a score that isn't there beats none
            return
        for at, old in near:
            self.cells[at] = [x for x in self.cells[at] if x[0] is not old]
        self.cells.setdefault(cell, []).append((row, feature))

    def rows(self, kind: T.StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        found = [row for held in self.cells.values() for row, _ in held]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(to_arrow_schema(kind))], names=[f.name for f in kind.fields])
