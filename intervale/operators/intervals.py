"""Interval operators over many recordings at once.

Every table carries ``recording_id``; intervals are ``start``/``stop`` in one
numeric unit.  Range conditions never stand alone: each side is dealt to time
buckets of a given width, joined on (recording, bucket), and the exact
condition is checked after that, so a recording of any length is spread over
tasks and no join degenerates to all pairs.  Conventions differ by operator and
are named by the predicates below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.text import strip as trimmed

KEY = "recording_id"


@dataclass(frozen=True)
class Levels:
    """Buckets for intervals of very unequal lengths, in place of one width: ``least``, twice that, and so on.

    An interval is at home in the buckets of the first level that is no shorter than
    itself, at most two, and calls at those of each higher level at which the other
    side has any home, at most two each.  So an interval is dealt to no more
    than two buckets a level, however long it is, where buckets of one width would be as
    many as the interval is long.  The levels that occur are read from both sides
    first; a caller keeps sides that are dear to work out.
    """

    least: float

    def __mul__(self, n: float) -> float:
        return self.least * n

    def level(self, start: Column, stop: Column) -> Column:
        return F.when(stop >= start, F.greatest(F.lit(0), F.ceil(F.log2((stop - start) / F.lit(float(self.least))))).cast("int"))

    def size(self, level: Column) -> Column:
        return F.pow(F.lit(2.0), level) * float(self.least)

    def buckets(self, start: Column, stop: Column, level: Column) -> Column:
        """(level, number) of the buckets of a level that the closed interval touches."""
        size = self.size(level)
        return F.transform(F.sequence(F.floor(start / size).cast("long"), F.floor(stop / size).cast("long")), lambda n: F.struct(level.cast("int").alias("level"), n.alias("n")))


#: Buckets of a join that make a block of an ordered pass.
BLOCK = 64
REF_TOKEN = r"\[\[REF:\d+\]\]"


# ---------------------------------------------------------------- predicates


def holds_point(start: Column, stop: Column, t: Column) -> Column:
    """Half-open: start <= t < stop."""
    return (start <= t) & (t < stop)


def holds_point_closed(start: Column, stop: Column, t: Column) -> Column:
    """Closed: start <= t <= stop."""
    return (start <= t) & (t <= stop)


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Open: touching intervals do not overlap."""
    return (a_start < b_stop) & (a_stop > b_start)


def word_in_window(w_start: Column, w_stop: Column, start: Column, stop: Column) -> Column:
    """Open overlap; a word of no length belongs where start <= word < stop."""
    return F.when(w_start == w_stop, holds_point(start, stop, w_start)).otherwise(overlaps(w_start, w_stop, start, stop))


def _buckets(start: Column, stop: Column, width: float) -> Column:
    """Numbers of all buckets that the closed interval touches; none for a null or reversed interval."""
    first, last = F.floor(start / width).cast("long"), F.floor(stop / width).cast("long")
    return F.when(stop >= start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _dealt_by_levels(rows: DataFrame, span: tuple[str, str], is_left: bool, levels: Column, width: Levels) -> DataFrame:
    """rows once for each bucket that they are at home in or call at, as ``_of_left`` (whose home), ``_l`` and ``_n``.

    ``levels`` are those of the other side.  Whose home a bucket is, is part of
    the key, so that intervals that only call at one never meet.
    """
    start, stop, own, theirs = F.col(span[0]), F.col(span[1]), F.col("_level"), F.col("_theirs")
    rows = rows.withColumn("_level", width.level(start, stop)).where(own.isNotNull()).withColumn("_theirs", levels)  # null and reversed intervals meet nothing
    home = F.when(F.exists(theirs, (lambda x: x <= own) if is_left else (lambda x: x < own)), width.buckets(start, stop, own))
    calls = F.flatten(F.transform(F.filter(theirs, lambda x: x > own if is_left else x >= own), lambda x: width.buckets(start, stop, x)))
    empty = F.array().cast("array<struct<of_left:boolean,level:int,n:bigint>>")
    tagged = lambda buckets, of_left: F.coalesce(F.transform(buckets, lambda x: F.struct(F.lit(of_left).alias("of_left"), x["level"].alias("level"), x["n"].alias("n"))), empty)
    every = rows.withColumn("_at", F.explode(F.concat(tagged(home, is_left), tagged(calls, not is_left))))
    return every.withColumns({"_of_left": F.col("_at.of_left"), "_l": F.col("_at.level"), "_n": F.col("_at.n")}).drop("_at", "_level", "_theirs")


def _meet_by_levels(left: DataFrame, right: DataFrame, width: Levels, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """A pair meets in the home of its longer interval, of two of one level in that of the left one."""

    def known(rows: DataFrame, span: tuple[str, str]) -> Column:
        levels = rows.select(width.level(F.col(span[0]), F.col(span[1])).alias("l")).agg(F.array_sort(F.collect_set("l")).alias("levels"))
        return F.coalesce(levels.scalar(), F.array().cast("array<int>"))

    a = _dealt_by_levels(left, left_span, True, known(right, right_span), width)
    b = _dealt_by_levels(right, right_span, False, known(left, left_span), width)
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width.size(F.col("_l"))).cast("long")
    return a.join(b, [KEY, "_of_left", "_l", "_n"]).where(F.col("_n") == first).drop("_of_left", "_l", "_n")


def _dealt(rows: DataFrame, start: str, stop: str, width: float, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(_buckets(F.col(start), F.col(stop), width)))


def meet(left: DataFrame, right: DataFrame, width: float | Levels, left_span: tuple[str, str] = ("start", "stop"), right_span: tuple[str, str] = ("r_start", "r_stop")) -> DataFrame:
    """Inner join of intervals that share a bucket, each pair once; the caller adds the exact condition.

    ``right`` has its own column names but for the recording key.  One width suits
    intervals of about that length or less; ``Levels`` take any lengths.
    """
    if isinstance(width, Levels):
        return _meet_by_levels(left, right, width, left_span, right_span)
    a = _dealt(left, *left_span, width, "_bucket")
    b = _dealt(right, *right_span, width, "_bucket")
    first = F.greatest(F.floor(F.col(left_span[0]) / width), F.floor(F.col(right_span[0]) / width))
    return a.join(b, [KEY, "_bucket"]).where(F.col("_bucket") == first).drop("_bucket")


# ---------------------------------------------------------------- points to intervals


def align(frames: DataFrame, segments: DataFrame, *, max_gap: float, width: float | Levels) -> DataFrame:
    """Each frame's segment, and whether that is context for it.

    frames (recording_id, frame_id, ts), segments (recording_id, segment_id,
    seq, start, stop).  The first segment in list order with start <= ts < stop
    is the one, with context.  Else it is the nearest: the gap is start - ts
    before it, ts - stop from its end on, ties to the earlier in list order;
    context if gap <= max_gap, so a frame exactly at an end has gap 0 and
    context.  No frame is dropped unless its recording has no segment at all.
    """
    spans = segments.select(KEY, F.col("segment_id").alias("r_id"), F.col("seq").alias("r_seq"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    points = frames.withColumn("_at", F.col("ts"))
    inside = meet(points, spans, width, ("ts", "_at")).where(holds_point(F.col("r_start"), F.col("r_stop"), F.col("ts")))
    inside = inside.groupBy(KEY, "frame_id", "ts").agg(F.min_by("r_id", "r_seq").alias("segment_id"))
    outside = frames.select(KEY, "frame_id", "ts").join(inside.select(KEY, "frame_id"), [KEY, "frame_id"], "left_anti")
    # The latest end of the spans that start before, and the earliest start after: within a block of time by windows over
    # points and spans, from all other blocks by one row a block, so a recording of any length is spread over tasks.
    as_struct = f"struct<at:{outside.schema['ts'].dataType.simpleString()},seq:bigint,id:bigint>"
    absent = F.lit(None).cast(as_struct)
    line = outside.select(KEY, F.col("ts").alias("t"), F.lit(1).alias("is_frame"), "frame_id", absent.alias("span_end"), absent.alias("span_start"))
    marks = spans.select(
        KEY, F.col("r_start").alias("t"), F.lit(0).alias("is_frame"), F.lit(None).cast(outside.schema["frame_id"].dataType).alias("frame_id"),
        F.struct(F.col("r_stop").alias("at"), (-F.col("r_seq")).cast("long").alias("seq"), F.col("r_id").cast("long").alias("id")).cast(as_struct).alias("span_end"),
        F.struct(F.col("r_start").alias("at"), F.col("r_seq").cast("long").alias("seq"), F.col("r_id").cast("long").alias("id")).cast(as_struct).alias("span_start"),
    )
    found = _nearest_both_ways(line.unionByName(marks), F.max("span_end"), F.min("span_start"), "t", "is_frame", width * BLOCK).where("is_frame = 1")
    gap_before, gap_after = F.col("t") - F.col("before.at"), F.col("after.at") - F.col("t")
    take_before = F.col("after").isNull() | (F.col("before").isNotNull() & ((gap_before < gap_after) | ((gap_before == gap_after) & (-F.col("before.seq") < F.col("after.seq")))))
    nearest = found.where("before is not null or after is not null").select(
        KEY, "frame_id", F.col("t").alias("ts"),
        F.when(take_before, F.col("before.id")).otherwise(F.col("after.id")).alias("segment_id"),
        (F.when(take_before, gap_before).otherwise(gap_after) <= max_gap).alias("has_audio_context"),
    )
    return inside.select(KEY, "frame_id", "ts", F.col("segment_id").cast("long").alias("segment_id"), F.lit(True).alias("has_audio_context")).unionByName(nearest)


def _nearest_both_ways(rows: DataFrame, before: Column, after: Column, at: str, tie: str, width: float) -> DataFrame:
    """rows plus ``before`` over all rows up to each one and ``after`` over all from it on, by (at, tie).

    ``before`` and ``after`` are aggregates that combine by greatest and least.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / width).cast("long"))
    whole = rows.groupBy(KEY, "_block").agg(before.alias("b"), after.alias("a"))
    blocks = Window.partitionBy(KEY).orderBy("_block")
    others = whole.select(
        KEY, "_block", F.max("b").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("a").over(Window.partitionBy(KEY).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    up = Window.partitionBy(KEY, "_block").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(KEY, "_block").orderBy(F.desc(at), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", before.over(up).alias("before"), after.over(down).alias("after"))
    return inside.join(others, [KEY, "_block"]).withColumns({"before": F.greatest("before", "_before"), "after": F.least("after", "_after")}).drop("_block", "_before", "_after")


def segment_at(points: DataFrame, segments: DataFrame, *, width: float | Levels) -> DataFrame:
    """points plus segment_id: the first segment in list order with start <= ts <= stop, or null."""
    spans = segments.select(KEY, F.col("segment_id").alias("r_id"), F.col("seq").alias("r_seq"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    hits = meet(points.select(KEY, "point_id", "ts", F.col("ts").alias("_at")), spans, width, ("ts", "_at"))
    hits = hits.where(holds_point_closed(F.col("r_start"), F.col("r_stop"), F.col("ts"))).groupBy(KEY, "point_id").agg(F.min_by("r_id", "r_seq").alias("segment_id"))
    return points.join(hits, [KEY, "point_id"], "left")


# ---------------------------------------------------------------- intervals to intervals


def overlap_slots(blocks: DataFrame, visuals: DataFrame, *, width: float | Levels) -> DataFrame:
    """A slot for each overlap of a block with a visual, clipped to both; touching ones give none.

    blocks (recording_id, block_id, start, stop), visuals (recording_id, ord,
    v_start, v_stop, further columns).  All pairs count, whatever ids they carry.
    """
    pairs = meet(blocks.select(KEY, "block_id", "start", "stop"), visuals.withColumnsRenamed({"v_start": "r_start", "v_stop": "r_stop"}), width)
    clipped = pairs.select("*", F.greatest("start", "r_start").alias("slot_start"), F.least("stop", "r_stop").alias("slot_stop"))
    return clipped.where("slot_start < slot_stop").drop("start", "stop", "r_start", "r_stop")


def nest_slots(blocks: DataFrame, slots: DataFrame, fields: list[str]) -> DataFrame:
    """blocks plus ``visuals``: its slots by start, then by ``ord``; an empty array without any."""
    item = F.struct("slot_start", "ord", *[f for f in fields if f not in ("slot_start", "ord")])
    nested = slots.groupBy(KEY, "block_id").agg(F.array_sort(F.collect_list(item)).alias("visuals"))
    joined = blocks.join(nested, [KEY, "block_id"], "left")
    return joined.withColumn("visuals", F.coalesce("visuals", F.array().cast(nested.schema["visuals"].dataType)))


def text_at(windows: DataFrame, segments: DataFrame, *, width: float | Levels, strict: bool = False) -> DataFrame:
    """windows (recording_id, window_id, start, stop) plus ``text`` of the segments in them, in list order.

    Loose: any overlap.  Strict: the segment lies within the window.  Reference
    marks are removed, pieces trimmed and blank ones left out; a window without a
    segment has the empty text.  See ``out_of_bounds`` for windows that are none.
    """
    spans = segments.select(KEY, F.col("seq").alias("r_seq"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.col("text").alias("r_text"))
    pairs = meet(windows, spans, width)
    a, b, c, d = (F.col(x) for x in ("start", "stop", "r_start", "r_stop"))
    pairs = pairs.where((c >= a) & (d <= b) if strict else overlaps(a, b, c, d))
    item = F.struct("r_seq", trimmed(F.regexp_replace("r_text", REF_TOKEN, "")).alias("text"))
    pairs = pairs.where(trimmed(F.regexp_replace("r_text", REF_TOKEN, "")) != "")
    texts = pairs.groupBy(KEY, "window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))
    return windows.join(texts, [KEY, "window_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def out_of_bounds(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Windows that are reversed, empty, or not within [0, duration] of their recording: (recording_id, window_id, rule)."""
    rows = windows.join(recordings.select(KEY, "duration"), KEY, "left")
    rule = F.when(F.col("start") >= F.col("stop"), "reversed").when((F.col("start") < 0) | (F.col("stop") > F.col("duration")) | F.col("duration").isNull(), "outside")
    return rows.select(KEY, "window_id", rule.alias("rule")).where("rule is not null")


def slice_words(markers: DataFrame, segments: DataFrame, words: DataFrame, *, width: float | Levels) -> DataFrame:
    """markers (recording_id, marker_id, start, stop) plus ``text`` of the words in them.

    Segments that do not overlap the marker are left out first.  A segment
    without words gives its whole text; else its words in the window are joined
    without a separator, and the trimmed pieces of segments with a space.
    """
    spans = segments.select(KEY, F.col("segment_id"), F.col("seq").alias("r_seq"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.col("text").alias("whole"))
    window = meet(markers, spans, width).where(overlaps(F.col("start"), F.col("stop"), F.col("r_start"), F.col("r_stop")))
    # One join: a segment without words comes back once, without a word.
    own = words.select(KEY, "segment_id", F.struct("word_pos", "word", F.col("start").alias("w_start"), F.col("stop").alias("w_stop")).alias("w"))
    joined = window.join(own, [KEY, "segment_id"], "left")
    inside = (F.col("w.word") != "") & word_in_window(F.col("w.w_start"), F.col("w.w_stop"), F.col("start"), F.col("stop"))
    cut = joined.groupBy(KEY, "marker_id", "r_seq").agg(F.first("whole").alias("whole"), F.count("w.word_pos").alias("n"), F.collect_list(F.when(inside, F.struct("w.word_pos", "w.word"))).alias("ws"))
    piece = F.when(F.col("n") == 0, F.col("whole")).otherwise(F.array_join(F.transform(F.array_sort("ws"), lambda x: x["word"]), ""))
    pieces = cut.select(KEY, "marker_id", "r_seq", trimmed(piece).alias("piece")).where("piece <> ''")
    texts = pieces.groupBy(KEY, "marker_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_seq", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return markers.join(texts, [KEY, "marker_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


# ---------------------------------------------------------------- snapping and coverage


def snap_candidates(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(recording_id, value): distinct word bounds, and the bounds of segments without words."""
    own = words.groupBy(KEY, "segment_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = segments.select(KEY, "segment_id", "start", "stop").join(own, [KEY, "segment_id"], "full_outer")
    spans = F.coalesce("spans", F.array(F.struct("start", "stop")))
    bounds = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["stop"])))
    return joined.select(KEY, F.explode(F.array_distinct(bounds)).alias("value")).distinct()


def snap(boundaries: DataFrame, candidates: DataFrame, *, warn_over: float, width: float | Levels) -> DataFrame:
    """boundaries (recording_id, boundary_id, value) plus snapped, distance and warned.

    The nearest candidate; of two as near, the greater.  A recording without
    candidates gives null, which a caller treats as an error.
    """
    line = boundaries.select(KEY, "value", F.lit(1).alias("is_boundary"), "boundary_id").unionByName(
        candidates.select(KEY, "value", F.lit(0).alias("is_boundary")), allowMissingColumns=True
    )
    given = F.when(F.col("is_boundary") == 0, F.col("value"))
    # Candidates come first among equal values on the way up, and on the way down by the same key turned round.
    line = line.withColumn("given", given)
    near = _nearest_both_ways(line, F.max("given"), F.min("given"), "value", "is_boundary", width * 1).where("is_boundary = 1")
    near = near.withColumnsRenamed({"before": "under", "after": "over"})
    near = near.withColumn("over", F.when(F.col("under") == F.col("value"), F.col("under")).otherwise(F.col("over")))
    above = F.col("under").isNull() | (F.col("over") - F.col("value") <= F.col("value") - F.col("under"))
    snapped = F.when(F.col("over").isNotNull() & above, F.col("over")).otherwise(F.col("under"))
    out = near.select(KEY, "boundary_id", "value", snapped.alias("snapped")).withColumn("distance", F.abs(F.col("snapped") - F.col("value")))
    return out.withColumn("warned", F.col("distance") > warn_over)


def uncovered_words(words: DataFrame, markers: DataFrame, *, width: float | Levels) -> DataFrame:
    """Words with a visible character that no marker touches (see ``word_in_window``)."""
    visible = words.where(F.regexp_replace("word", r"(?U)\s+", "") != "")
    if isinstance(width, Levels):
        long_spans = islands(markers).select(KEY, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
        hits = meet(visible.select(KEY, "segment_id", "word_pos", "start", "stop"), long_spans, width).where(word_in_window(F.col("start"), F.col("stop"), F.col("r_start"), F.col("r_stop")))
        return visible.join(hits.select(KEY, "segment_id", "word_pos").distinct(), [KEY, "segment_id", "word_pos"], "left_anti")
    spans = _dealt(islands(markers).select(KEY, F.col("start").alias("r_start"), F.col("stop").alias("r_stop")), "r_start", "r_stop", width, "_bucket")
    # Touching markers are one span, so a word meets a marker if and only if it meets a span.
    dealt = _dealt(visible, "start", "stop", width, "_bucket")
    met = dealt.join(spans, [KEY, "_bucket"], "left")
    hit = F.coalesce(word_in_window(F.col("start"), F.col("stop"), F.col("r_start"), F.col("r_stop")), F.lit(False))
    rest = [F.first(c).alias(c) for c in visible.columns if c not in (KEY, "segment_id", "word_pos")]
    alone = met.groupBy(KEY, "segment_id", "word_pos").agg(F.bool_or(hit).alias("_hit"), *rest)
    return alone.where("not _hit").select(*visible.columns)


def islands(intervals: DataFrame) -> DataFrame:
    """The union of each recording's intervals as disjoint ones; touching intervals merge."""
    order = Window.partitionBy(KEY).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(KEY, "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    numbered = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(KEY, "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("n")


def uncovered_lines(lines: DataFrame, markers: DataFrame, *, width: float | Levels) -> DataFrame:
    """Lines (recording_id, segment_id, start, stop) that the union of the markers does not cover entirely."""
    spans = islands(markers).select(KEY, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    covered = meet(lines, spans, width).where("r_start <= start and stop <= r_stop").select(KEY, "segment_id").distinct()
    return lines.join(covered, [KEY, "segment_id"], "left_anti")


# ---------------------------------------------------------------- id ranges


def block_chapters(chapters: DataFrame, value: str = "chapter_id") -> DataFrame:
    """(recording_id, block_id, chapter_id or another value): closed ranges written out; of overlapping chapters the later in the list."""
    rows = chapters.where("block_id_start <= block_id_end").select(KEY, value, "seq", F.explode(F.sequence("block_id_start", "block_id_end")).alias("block_id"))
    return rows.groupBy(KEY, "block_id").agg(F.max_by(value, "seq").alias(value))


def chapter_blocks(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every (chapter, block) with block_id_start <= block_id <= block_id_end, by an equality join on the written-out range."""
    rows = chapters.where("block_id_start <= block_id_end").withColumn("block_id", F.explode(F.sequence("block_id_start", "block_id_end")))
    return rows.join(blocks, [KEY, "block_id"])
