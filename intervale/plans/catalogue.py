"""Queries over the driver's tables, one for each operator, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.functions import text as fn
from intervale.operators import admission, intervals, memo, selection, sequence, validate
from intervale.plans import bindings as b
from intervale.plans import notes
from intervale.plans.bindings import HOUR, KEY, Tables
from intervale.schemas import TEXT_MEDIA
from intervale.settling import fresh_folder, settle
from intervale.shipping import ship
from intervale.sources import files
from intervale.streaming import events

DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- intervals


@query(f"""
    WITH f AS ({b.FRAMES}), s AS ({b.SEGMENTS}),
    p AS (SELECT f.recording_id, frame_id, ts, segment_id, CASE WHEN ts < start THEN start - ts WHEN ts >= stop THEN ts - stop ELSE -1 END AS gap FROM f JOIN s USING (recording_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_id ORDER BY gap >= 0, gap, segment_id) AS k FROM p)
    SELECT recording_id, frame_id, ts, segment_id, gap <= 7200000000 AS has_audio_context FROM r WHERE k = 1
""")
def align_nearest(t: Tables) -> DataFrame:
    return intervals.align(t.frames(), t.segments(), max_gap=2 * HOUR, width=DAY)


@query(SQL["align_nearest"])
def align_nearest_stream(t: Tables) -> DataFrame:
    """The same from a stream: frames and ended segments land in three parts, each up to an hour after its time, in any order; a run takes up a part from where the last one stopped."""
    ship(t.spark)
    came, folder, out, state = (fresh_folder(t.spark, x) for x in ("marks", "landed", "aligned", "progress"))
    arrived = F.greatest("start", F.coalesce("stop", "start")) + F.pmod(F.xxhash64("kind", "id", KEY), F.lit(HOUR))
    events.marks(t.frames(), t.segments()).withColumn("arrived", arrived).write.parquet(came)
    every = t.spark.read.parquet(came)
    first, last, longest = every.agg(F.min("arrived"), F.max("arrived"), F.max(F.col("stop") - F.col("start"))).first()
    third = ((last or 0) - (first or 0)) // 3 + 1
    late = f"{(longest or 0) + HOUR + third} microseconds"  # a part's own length, since its rows come in any order
    end = t.spark.range(1).select(F.lit("").alias(KEY), F.lit("end").alias("kind"), events.event_time(F.lit((last or 0) * 2 - (first or 0) + (longest or 0) + 2 * HOUR + third)).alias("at"))
    for part in range(4):
        rows = every.where(F.floor((F.col("arrived") - (first or 0)) / third) == part).drop("arrived") if part < 3 else end
        rows.write.mode("append").parquet(folder)
        stream = events.nearest_stream(t.spark.readStream.schema(events.MARKS).parquet(folder), max_gap=2 * HOUR, late=late)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    key = t.frames().schema[KEY].dataType
    return t.spark.read.schema(f"{KEY} string, frame_id long, ts long, segment_id long, has_audio_context boolean").parquet(out).withColumn(KEY, F.col(KEY).cast(key))


@query(f"""
    WITH f AS ({b.FRAMES}), s AS ({b.SEGMENTS})
    SELECT f.recording_id, f.frame_id AS point_id, f.ts, min(segment_id) AS segment_id
    FROM f LEFT JOIN s ON f.recording_id = s.recording_id AND start <= ts AND ts <= stop GROUP BY ALL
""")
def segment_at_closed(t: Tables) -> DataFrame:
    return intervals.segment_at(t.frames().select(KEY, F.col("frame_id").alias("point_id"), "ts"), t.segments(), width=DAY)


VISUALS = f"SELECT recording_id, frame_id AS ord, ts - 14400000000 AS v_start, ts + 14400000000 AS v_stop FROM ({b.FRAMES})"


def _visuals(t: Tables) -> DataFrame:
    return t.frames().select(KEY, F.col("frame_id").alias("ord"), (F.col("ts") - 4 * HOUR).alias("v_start"), (F.col("ts") + 4 * HOUR).alias("v_stop"))


SLOTS = f"""
    SELECT s.recording_id, segment_id AS block_id, ord, greatest(start, v_start) AS slot_start, least(stop, v_stop) AS slot_stop
    FROM ({b.SEGMENTS}) s JOIN ({VISUALS}) v ON s.recording_id = v.recording_id AND start < v_stop AND stop > v_start"""


def _slots(t: Tables) -> DataFrame:
    return intervals.overlap_slots(t.segments().withColumnRenamed("segment_id", "block_id"), _visuals(t), width=DAY)


@query(SLOTS)
def unify_overlap_slots(t: Tables) -> DataFrame:
    return _slots(t).select(KEY, "block_id", "ord", "slot_start", "slot_stop")


@query(f"""
    SELECT s.recording_id, s.segment_id AS block_id, count(x.ord) AS n_slots, coalesce(min(x.slot_start), -1) AS first_start,
           coalesce(string_agg(x.ord::VARCHAR, ',' ORDER BY x.slot_start, x.ord), '') AS ords
    FROM ({b.SEGMENTS}) s LEFT JOIN ({SLOTS}) x ON s.recording_id = x.recording_id AND s.segment_id = x.block_id GROUP BY ALL
""")
def unify_blocks_nested(t: Tables) -> DataFrame:
    nested = intervals.nest_slots(t.segments().withColumnRenamed("segment_id", "block_id"), _slots(t), ["slot_stop"])
    return nested.select(
        KEY, "block_id", F.size("visuals").cast("long").alias("n_slots"), F.coalesce(F.get("visuals.slot_start", F.lit(0)), F.lit(-1)).cast("long").alias("first_start"),
        F.array_join(F.transform("visuals", lambda v: v["ord"].cast("string")), ",").alias("ords"),
    )


#: Spans from a second to over a day long, by the event's id.
LONG = "SELECT event_type, user_id AS recording_id, event_id, epoch_us(ts) AS start, epoch_us(ts) + (1000000 * pow(10, event_id % 6))::BIGINT AS stop FROM events"


def _long_spans(t: Tables) -> DataFrame:
    return t.events().select("event_type", F.col("user_id").alias(KEY), "event_id", F.col("us").alias("start"), (F.col("us") + (1_000_000 * F.pow(F.lit(10), F.col("event_id") % 6)).cast("long")).alias("stop"))


@query(f"""
    WITH e AS ({LONG}), a AS (SELECT * FROM e WHERE event_type <> 'error'), v AS (SELECT * FROM e WHERE event_type = 'error')
    SELECT a.recording_id, a.event_id AS block_id, v.event_id AS ord, greatest(a.start, v.start) AS slot_start, least(a.stop, v.stop) AS slot_stop
    FROM a JOIN v ON a.recording_id = v.recording_id AND a.start < v.stop AND a.stop > v.start
""")
def unequal_overlap_slots(t: Tables) -> DataFrame:
    """Overlaps of intervals whose lengths span five orders of magnitude."""
    spans = _long_spans(t)
    blocks = spans.where("event_type <> 'error'").select(KEY, F.col("event_id").alias("block_id"), "start", "stop")
    visuals = spans.where("event_type = 'error'").select(KEY, F.col("event_id").alias("ord"), F.col("start").alias("v_start"), F.col("stop").alias("v_stop"))
    return intervals.overlap_slots(blocks, visuals, width=intervals.Levels(1_000_000)).select(KEY, "block_id", "ord", "slot_start", "slot_stop")


@query(f"""
    WITH e AS ({LONG}), f AS ({b.FRAMES})
    SELECT f.recording_id, f.frame_id AS point_id, f.ts, min(e.event_id) AS segment_id
    FROM f LEFT JOIN (SELECT * FROM e WHERE event_type <> 'error') e ON f.recording_id = e.recording_id AND start <= ts AND ts <= stop GROUP BY ALL
""")
def unequal_segment_at(t: Tables) -> DataFrame:
    """Points in segments of a second to over a day."""
    segments = _long_spans(t).where("event_type <> 'error'").select(KEY, F.col("event_id").alias("segment_id"), F.col("event_id").alias("seq"), "start", "stop")
    return intervals.segment_at(t.frames().select(KEY, F.col("frame_id").alias("point_id"), "ts"), segments, width=intervals.Levels(1_000_000))


def _text_sql(condition: str) -> str:
    return f"""
    WITH w AS ({b.MARKERS}), s AS ({b.LINES})
    SELECT w.recording_id, marker_id AS window_id, w.start, w.stop, coalesce(string_agg(text, ' ' ORDER BY seq), '') AS text
    FROM w LEFT JOIN s ON w.recording_id = s.recording_id AND {condition} GROUP BY ALL"""


@query(_text_sql("s.start < w.stop AND s.stop > w.start"))
def text_at_loose(t: Tables) -> DataFrame:
    return intervals.text_at(t.markers().withColumnRenamed("marker_id", "window_id"), t.lines().drop("role"), width=500)


@query(_text_sql("s.start >= w.start AND s.stop <= w.stop"))
def text_at_strict(t: Tables) -> DataFrame:
    return intervals.text_at(t.markers().withColumnRenamed("marker_id", "window_id"), t.lines().drop("role"), width=500, strict=True)


@query(f"""
    WITH m AS ({b.MARKERS}), s AS ({b.LINES}), w AS ({b.WORDS}),
    o AS (SELECT m.recording_id, m.marker_id, m.start, m.stop, s.segment_id, s.seq, s.text,
                 EXISTS (SELECT 1 FROM w WHERE w.recording_id = s.recording_id AND w.segment_id = s.segment_id) AS worded
          FROM m JOIN s ON m.recording_id = s.recording_id AND s.start < m.stop AND s.stop > m.start),
    c AS (SELECT o.recording_id, o.marker_id, o.seq, string_agg(word, '' ORDER BY word_pos) AS piece
          FROM o JOIN w ON w.recording_id = o.recording_id AND w.segment_id = o.segment_id AND word <> ''
               AND CASE WHEN w.start = w.stop THEN o.start <= w.start AND w.start < o.stop ELSE w.start < o.stop AND w.stop > o.start END
          WHERE worded GROUP BY ALL
          UNION ALL SELECT recording_id, marker_id, seq, trim(text) FROM o WHERE NOT worded),
    g AS (SELECT recording_id, marker_id, string_agg(piece, ' ' ORDER BY seq) AS text FROM c WHERE piece <> '' GROUP BY ALL)
    SELECT m.recording_id, m.marker_id, m.start, m.stop, coalesce(g.text, '') AS text FROM m LEFT JOIN g USING (recording_id, marker_id)
""")
def slice_words(t: Tables) -> DataFrame:
    return intervals.slice_words(t.markers(), t.lines().drop("role"), t.words(), width=500)


CANDIDATES = f"""
    SELECT DISTINCT recording_id, unnest([start, stop]) AS value FROM ({b.WORDS})
    UNION SELECT DISTINCT recording_id, unnest([start, stop]) FROM ({b.LINES}) WHERE role = 'system' """


@query(f"""
    WITH c AS ({CANDIDATES}), d AS (SELECT recording_id, marker_id * 2 AS boundary_id, start AS value FROM ({b.MARKERS}) UNION ALL SELECT recording_id, marker_id * 2 + 1, stop FROM ({b.MARKERS})),
    r AS (SELECT d.recording_id, boundary_id, d.value, c.value AS snapped, row_number() OVER (PARTITION BY d.recording_id, boundary_id ORDER BY abs(c.value - d.value), c.value DESC) AS k
          FROM d JOIN c USING (recording_id))
    SELECT recording_id, boundary_id, value, snapped, abs(snapped - value) AS distance, abs(snapped - value) > 2 AS warned FROM r WHERE k = 1
""")
def snap_boundaries(t: Tables) -> DataFrame:
    ends = t.markers().select(KEY, F.explode(F.array(F.struct((F.col("marker_id") * 2).alias("id"), F.col("start").alias("at")), F.struct((F.col("marker_id") * 2 + 1).alias("id"), F.col("stop").alias("at")))).alias("e"))
    candidates = intervals.snap_candidates(t.words(), t.lines().select(KEY, "segment_id", "start", "stop"))
    return intervals.snap(ends.select(KEY, F.col("e.id").alias("boundary_id"), F.col("e.at").alias("value")), candidates, warn_over=2, width=500)


@query(CANDIDATES)
def snap_candidates(t: Tables) -> DataFrame:
    return intervals.snap_candidates(t.words(), t.lines().select(KEY, "segment_id", "start", "stop"))


@query(f"""
    WITH w AS ({b.WORDS}), m AS ({b.MARKERS})
    SELECT * FROM w WHERE trim(word) <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.recording_id = w.recording_id
        AND CASE WHEN w.start = w.stop THEN m.start <= w.start AND w.start < m.stop ELSE w.start < m.stop AND w.stop > m.start END)
""")
def uncovered_words(t: Tables) -> DataFrame:
    return intervals.uncovered_words(t.words(), t.markers(), width=500).select(KEY, "segment_id", "word_pos", "word", "start", "stop")


@query(f"""
    WITH l AS (SELECT recording_id, segment_id, start, stop FROM ({b.LINES})),
    m AS (SELECT recording_id, marker_id, start - 50 AS start, stop + 50 AS stop FROM ({b.MARKERS})),
    o AS (SELECT l.recording_id, l.segment_id, l.start, l.stop, m.start AS a, m.stop AS z,
                 coalesce(max(m.stop) OVER (PARTITION BY l.recording_id, l.segment_id ORDER BY m.start, m.stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l.start) AS cursor
          FROM l JOIN m ON l.recording_id = m.recording_id AND m.start <= l.stop AND m.stop >= l.start),
    c AS (SELECT recording_id, segment_id FROM o GROUP BY recording_id, segment_id HAVING bool_and(a <= greatest(cursor, start)) AND max(z) >= max(stop) AND min(a) <= min(start))
    SELECT l.* FROM l ANTI JOIN c USING (recording_id, segment_id)
""")
def uncovered_lines(t: Tables) -> DataFrame:
    wide = t.markers().select(KEY, (F.col("start") - 50).alias("start"), (F.col("stop") + 50).alias("stop"))
    return intervals.uncovered_lines(t.lines().select(KEY, "segment_id", "start", "stop"), wide, width=500)


@query(f"""
    WITH c AS ({b.CHAPTERS}), x AS (SELECT o_custkey AS recording_id, l_linenumber AS block_id, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT c.recording_id, chapter_id, seq, block_id_start, block_id_end, block_id::BIGINT AS block_id, lines
    FROM c JOIN x ON c.recording_id = x.recording_id AND block_id BETWEEN block_id_start AND block_id_end
""")
def chapter_blocks(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    blocks = lines.groupBy(F.col("o_custkey").alias(KEY), F.col("l_linenumber").cast("long").alias("block_id")).agg(F.count("*").alias("lines"))
    return intervals.chapter_blocks(t.chapters(), blocks).select(KEY, "chapter_id", "seq", "block_id_start", "block_id_end", "block_id", "lines")


@query(f"""
    SELECT recording_id, block_id, arg_max(chapter_id, seq) AS chapter_id
    FROM (SELECT *, unnest(range(block_id_start, block_id_end + 1)) AS block_id FROM ({b.CHAPTERS})) GROUP BY ALL
""")
def block_chapter_map(t: Tables) -> DataFrame:
    return intervals.block_chapters(t.chapters())


# ---------------------------------------------------------------- selection


@query(f"""
    SELECT recording_id, semantic_key, frame_id FROM (
      SELECT *, row_number() OVER (PARTITION BY recording_id, semantic_key ORDER BY quality_score DESC, visible_length DESC, sharpness DESC, frame_id) AS k FROM ({b.JUDGED}) WHERE is_meaningful)
    WHERE k = 1
""")
def semantic_representative(t: Tables) -> DataFrame:
    return selection.representatives(t.judged())


SCENES = """
    SELECT user_id AS recording_id, h AS threshold, epoch_us(ts) // 1000000 - 1704067200 - 300000 AS start, epoch_us(ts) // 1000000 - 1704067200 - 300000 + h * 900 AS stop
    FROM events, (SELECT unnest([10, 15, 20, 25]) AS h) WHERE event_id % 40 < h"""
DURATIONS = "SELECT user_id AS recording_id, 600000 + (user_id % 9) * 100000 AS duration FROM events GROUP BY user_id"
CLAMPED = f"""
    WITH s AS (SELECT x.*, duration FROM ({SCENES}) x JOIN ({DURATIONS}) d USING (recording_id)),
    i AS (SELECT recording_id, threshold, greatest(start, 0) AS start, least(stop, duration) AS stop FROM s WHERE greatest(start, 0) < least(stop, duration))
    SELECT * FROM i UNION ALL
    SELECT DISTINCT recording_id, threshold, 0, duration FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.recording_id = s.recording_id AND i.threshold = s.threshold)"""


def _durations(t: Tables) -> DataFrame:
    return t.events().groupBy(F.col("user_id").alias(KEY)).agg(F.lit(1).alias("_")).select(KEY, (600000 + (F.col(KEY) % 9) * 100000).alias("duration"))


def _scenes(t: Tables) -> DataFrame:
    rows = t.events().select(F.col("user_id").alias(KEY), "event_id", F.explode(F.array(*map(F.lit, (10, 15, 20, 25)))).alias("threshold"), (F.expr("us div 1000000") - 1704067200 - 300000).alias("start"))
    return rows.where("event_id % 40 < threshold").select(KEY, "threshold", "start", (F.col("start") + F.col("threshold") * 900).alias("stop"))


def _clamped(t: Tables) -> DataFrame:
    return selection.clamp_scenes(_scenes(t), _durations(t))


@query(f"SELECT recording_id, threshold, start::BIGINT AS start, stop::BIGINT AS stop FROM ({CLAMPED})")
def scene_clamp_default(t: Tables) -> DataFrame:
    return _clamped(t)


@query(f"""
    WITH n AS (SELECT recording_id, threshold, count(*) AS scenes FROM ({CLAMPED}) GROUP BY ALL),
    x AS (SELECT n.*, greatest(1, round_even(duration / 60 * 0.0015, 0)::BIGINT) AS target FROM n JOIN ({DURATIONS}) USING (recording_id))
    SELECT recording_id, threshold, scenes, target FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY abs(scenes - target), scenes, threshold DESC) AS k FROM x) WHERE k = 1
""")
def scene_threshold_argmin(t: Tables) -> DataFrame:
    counts = _clamped(t).groupBy(KEY, "threshold").agg(F.count("*").alias("scenes"))
    return selection.scene_threshold(counts, _durations(t), per_minute=0.0015)


@query(f"""
    WITH f AS (SELECT recording_id, frame_id, ts, score FROM ({b.FRAMES})),
    g AS (SELECT *, max(score) OVER (PARTITION BY recording_id) AS best, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, frame_id) AS k FROM f)
    SELECT recording_id, frame_id, ts, score FROM g WHERE score >= 150 OR (best < 150 AND k = 1)
""")
def low_info_filter_fallback(t: Tables) -> DataFrame:
    return selection.content_filter(t.frames(), least=150.0)


@query(f"""
    SELECT recording_id, window_id, arg_max(frame_id, (score, ts, frame_id)) AS frame_id, max(score) AS score
    FROM (SELECT recording_id, ts // 604800000000 AS window_id, frame_id, ts, floor(score / 10) AS score FROM ({b.FRAMES})) GROUP BY ALL
""")
def window_best_frame(t: Tables) -> DataFrame:
    rows = t.frames().select(KEY, F.expr("ts div 604800000000").alias("window_id"), "frame_id", "ts", F.floor(F.col("score") / 10).cast("double").alias("score"))
    return selection.best_frame(rows)


@query(f"""
    SELECT recording_id, ts, arg_min(frame_id, seq) AS frame_id, min(seq) AS seq
    FROM (SELECT recording_id, frame_id, frame_id AS seq, ts // 86400000000 AS ts FROM ({b.FRAMES})) GROUP BY ALL
""")
def timestamp_dedupe(t: Tables) -> DataFrame:
    return selection.distinct_times(t.frames().select(KEY, "frame_id", F.col("frame_id").alias("seq"), F.expr("ts div 86400000000").alias("ts")))


@query("""
    WITH items AS (SELECT label AS recording_id, list({'seq': vec_id, 'f': embedding::DOUBLE[], 's': (vec_id * 37 % 101)::DOUBLE} ORDER BY vec_id) AS xs FROM embeddings GROUP BY label),
    near AS (SELECT recording_id, list_reduce(xs, lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda k: list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.1327)) = 0 THEN list_append(acc, x)
             WHEN x.s > list_max(list_transform(list_filter(acc, lambda k: list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.1327), lambda k: k.s))
             THEN list_append(list_filter(acc, lambda k: NOT (list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.1327)), x)
             ELSE acc END, []::STRUCT(seq BIGINT, f DOUBLE[], s DOUBLE)[]) AS kept FROM
        (SELECT recording_id, list_transform(xs, lambda x: {'seq': x.seq, 'f': x.f, 's': x.s}) AS xs FROM items))
    SELECT recording_id, k.seq AS seq, k.seq AS item_id, k.s AS score FROM (SELECT recording_id, unnest(kept) AS k FROM near)
""")
def greedy_near_duplicate(t: Tables) -> DataFrame:
    items = t.raw("embeddings").select(F.col("label").alias(KEY), F.col("vec_id").alias("seq"), F.col("vec_id").alias("item_id"), (F.col("vec_id") * 37 % 101).cast("double").alias("score"), F.col("embedding").alias("feature"))
    return selection.greedy_dedupe(items, threshold=0.1327)


@query("""
    WITH items AS (SELECT 0 AS recording_id, list({'seq': vec_id, 'f': embedding::DOUBLE[], 's': (vec_id * 37 % 101)::DOUBLE} ORDER BY vec_id) AS xs FROM embeddings),
    near AS (SELECT recording_id, list_reduce(xs, lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda k: list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.12)) = 0 THEN list_append(acc, x)
             WHEN x.s > list_max(list_transform(list_filter(acc, lambda k: list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.12), lambda k: k.s))
             THEN list_append(list_filter(acc, lambda k: NOT (list_sum(list_transform(list_zip(k.f, x.f), lambda p: abs(p[1] - p[2]))) / 64 < 0.12)), x)
             ELSE acc END, []::STRUCT(seq BIGINT, f DOUBLE[], s DOUBLE)[]) AS kept FROM
        (SELECT recording_id, list_transform(xs, lambda x: {'seq': x.seq, 'f': x.f, 's': x.s}) AS xs FROM items))
    SELECT recording_id, k.seq AS seq, k.seq AS item_id, k.s AS score FROM (SELECT recording_id, unnest(kept) AS k FROM near)
""")
def spread_near_duplicate(t: Tables) -> DataFrame:
    """All vectors as the frames of one recording, region by region."""
    v = t.raw("embeddings")
    items = v.select(F.lit(0).alias(KEY), F.col("vec_id").alias("seq"), F.col("vec_id").alias("item_id"), (F.col("vec_id") * 37 % 101).cast("double").alias("score"), F.col("embedding").alias("feature"))
    return selection.spread_greedy(items, threshold=0.12, settle=settle)


@query(f"""
    SELECT recording_id, count(*) AS frames, count(*) FILTER (WHERE score >= 150) AS rich, min(ts) AS first_ts, max(ts) AS last_ts FROM ({b.FRAMES}) GROUP BY recording_id
""")
def batch_summary(t: Tables) -> DataFrame:
    return t.frames().groupBy(KEY).agg(F.count("*").alias("frames"), F.count_if(F.col("score") >= 150).alias("rich"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---------------------------------------------------------------- order


@query(f"SELECT recording_id, segment_id, (row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1) // 8 AS batch FROM ({b.LINES})")
def batch_assign(t: Tables) -> DataFrame:
    return sequence.batches(t.lines(), size=8).select(KEY, "segment_id", "batch")


@query(f"""
    SELECT recording_id, segment_id FROM (SELECT *, sum(CASE WHEN length(text) % 11 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bad FROM ({b.LINES})) WHERE bad = 0
""")
def valid_prefix(t: Tables) -> DataFrame:
    return sequence.valid_prefix(t.lines().withColumn("is_valid", F.length("text") % 11 != 0)).select(KEY, "segment_id")


@query(f"SELECT recording_id, segment_id, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS new_id FROM ({b.LINES}) WHERE role <> 'system'")
def dense_renumber(t: Tables) -> DataFrame:
    return sequence.renumber(t.lines(), "role <> 'system'").select(KEY, "segment_id", "new_id")


@query(f"""
    SELECT recording_id, segment_id, last_value(CASE WHEN role = 'user' THEN stop END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM ({b.LINES})
""")
def previous_kept_end(t: Tables) -> DataFrame:
    return sequence.previous_kept_end(t.lines(), "role = 'user'").select(KEY, "segment_id", "previous_end")


@query(f"SELECT recording_id, segment_id, max(least(stop, 400)) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS done FROM ({b.LINES})")
def progress_watermark(t: Tables) -> DataFrame:
    return sequence.progress(t.lines().withColumn("duration", F.lit(400).cast("long"))).select(KEY, "segment_id", "done")


@query(f"SELECT recording_id, frame_id, frame_id / 0.25::DOUBLE AS ts FROM (SELECT recording_id, unnest(range(0, ceil(duration * 0.25::DOUBLE)::BIGINT))::INT AS frame_id FROM (SELECT recording_id, max(stop) / 10 AS duration FROM ({b.LINES}) GROUP BY recording_id))")
def fixed_rate_frames(t: Tables) -> DataFrame:
    return sequence.fixed_rate_times(t.lines().groupBy(KEY).agg((F.max("stop") / 10).alias("duration")), fps=0.25)


@query(f"""
    SELECT a.recording_id, a.segment_id, b.segment_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n FROM ({b.LINES}) WHERE role = 'user') a
    JOIN (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n FROM ({b.LINES}) WHERE role = 'assistant') b ON a.recording_id = b.recording_id AND a.n = b.n
""")
def positional_zip(t: Tables) -> DataFrame:
    lines = t.lines()
    left = lines.where("role = 'user'").select(KEY, "seq", "segment_id")
    right = lines.where("role = 'assistant'").select(KEY, "seq", F.col("segment_id").alias("other"))
    return sequence.zip_lists(left, right).select(KEY, "segment_id", "other")


@query(f"SELECT recording_id, segment_id, start FROM ({b.LINES}) WHERE start < 300")
def head_trim(t: Tables) -> DataFrame:
    return sequence.head(t.lines(), minutes=5).select(KEY, "segment_id", "start")


# ---------------------------------------------------------------- rules

BENT = f"""
    SELECT recording_id, seq, CASE WHEN seq % 9 = 8 THEN seq + 1 ELSE seq END AS id, start - CASE WHEN seq % 5 = 4 THEN 3 ELSE 0 END AS start,
           CASE WHEN seq % 13 = 12 THEN start - 5 ELSE stop END AS stop FROM ({b.LINES})"""


def _bent(t: Tables) -> DataFrame:
    seq = F.col("seq")
    return t.lines().select(
        KEY, "seq", F.when(seq % 9 == 8, seq + 1).otherwise(seq).alias("id"), (F.col("start") - F.when(seq % 5 == 4, 3).otherwise(0)).alias("start"),
        F.when(seq % 13 == 12, F.col("start") - 5).otherwise(F.col("stop")).alias("stop"),
    )


def _lengths(t: Tables) -> DataFrame:
    return t.lines().groupBy(KEY).agg((F.max("stop") - F.col(KEY) % 2).alias("duration"))


@query(f"""
    WITH m AS (SELECT *, row_number() OVER w - 1 AS pos, lead(start) OVER w AS next_start, lead(id) OVER w AS next_id FROM ({BENT}) WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
    d AS (SELECT recording_id, max(stop) - recording_id % 2 AS duration FROM ({b.LINES}) GROUP BY recording_id), x AS (SELECT * FROM m JOIN d USING (recording_id))
    SELECT recording_id, seq AS row_id, 'id' AS rule FROM x WHERE id <> pos
    UNION ALL SELECT recording_id, seq, 'interval' FROM x WHERE start >= stop
    UNION ALL SELECT recording_id, seq, 'overlap' FROM x WHERE stop > next_start
    UNION ALL SELECT recording_id, seq, 'before_zero' FROM x WHERE pos = 0 AND start < 0
    UNION ALL SELECT recording_id, seq, 'past_end' FROM x WHERE next_id IS NULL AND stop > duration
""")
def marker_violations(t: Tables) -> DataFrame:
    return validate.marker_violations(_bent(t), _lengths(t))


@query(f"""
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS pos, CASE WHEN seq % 7 = 6 THEN seq ELSE seq - 1 END AS ref FROM ({BENT})),
    s AS (SELECT recording_id, marker_id % 5 AS block_id, start AS slot_start, stop AS slot_stop FROM ({b.MARKERS}))
    SELECT recording_id, seq AS row_id, 'id' AS rule FROM x WHERE id <> pos
    UNION ALL SELECT recording_id, seq, 'interval' FROM x WHERE start >= stop
    UNION ALL SELECT recording_id, seq, 'cross_ref' FROM x WHERE ref < 0 OR ref >= id
    UNION ALL SELECT DISTINCT s.recording_id, seq, 'slot' FROM s JOIN x ON s.recording_id = x.recording_id AND s.block_id = x.id WHERE slot_start >= slot_stop OR slot_start < start OR slot_stop > stop
""")
def block_violations(t: Tables) -> DataFrame:
    blocks = _bent(t).withColumn("cross_refs", F.array(F.when(F.col("seq") % 7 == 6, F.col("seq")).otherwise(F.col("seq") - 1)))
    slots = t.markers().select(KEY, (F.col("marker_id") % 5).alias("block_id"), F.col("start").alias("slot_start"), F.col("stop").alias("slot_stop"))
    return validate.block_violations(blocks, slots)


OUTLINES = """
    SELECT o_custkey AS recording_id, n AS seq, CASE WHEN o_custkey % 5 = 1 AND n = 2 THEN 9 ELSE n END AS id, (n - 1) * 3 + CASE WHEN o_custkey % 7 = 3 AND n = 3 THEN 1 ELSE 0 END AS block_id_start, n * 3 - 1 AS block_id_end
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""


@query(f"""
    WITH c AS (SELECT *, row_number() OVER w - 1 AS pos, lead(block_id_start) OVER w AS next_start FROM ({OUTLINES}) WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
    f AS (SELECT recording_id, arg_min(block_id_start, pos) AS a, arg_max(block_id_end, pos) AS z, bool_or(id <> pos + 1 OR block_id_start > block_id_end) AS bad_id, bool_or(coalesce(block_id_end + 1 <> next_start, false)) AS gap FROM c GROUP BY recording_id),
    s AS (SELECT c_custkey AS recording_id, coalesce(n, 0) * 3 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)
    SELECT * FROM (SELECT s.recording_id, CASE WHEN a IS NULL THEN 'empty' WHEN a <> 0 OR z <> n - 1 THEN 'coverage' WHEN bad_id THEN 'id' WHEN gap THEN 'contiguity' END AS rule FROM s LEFT JOIN f USING (recording_id)) WHERE rule IS NOT NULL
""")
def outline_violations(t: Tables) -> DataFrame:
    c = t.chapters()
    n, key = F.col("seq"), F.col(KEY)
    chapters = c.select(
        KEY, "seq", F.when((key % 5 == 1) & (n == 2), 9).otherwise(n).alias("id"), (F.col("block_id_start") + F.when((key % 7 == 3) & (n == 3), 1).otherwise(0)).alias("block_id_start"), (n * 3 - 1).alias("block_id_end")
    )
    orders = t.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    sizes = t.raw("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias(KEY), (F.coalesce("orders", F.lit(0)) * 3 + F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0)).alias("n"))
    return validate.outline_violations(chapters, sizes)


JUDGEMENTS = """
    SELECT lang AS recording_id, doc_id AS frame_id, CASE doc_id % 6 WHEN 0 THEN 'ppt' WHEN 1 THEN 'speaker' WHEN 2 THEN 'poster' ELSE 'chart' END AS medium, toxic = 0 AS is_meaningful,
           CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE 'seen' END AS reason, CASE WHEN toxic = 0 OR doc_id % 4 = 0 THEN source END AS semantic_key,
           CASE WHEN toxic = 0 THEN quality * 3 + (doc_id % 4)::INT END AS quality_score, CASE WHEN doc_id % 12 = 5 THEN '' ELSE source END AS content_summary
    FROM documents JOIN labels USING (doc_id)"""


@query(f"""
    WITH j AS ({JUDGEMENTS} UNION ALL SELECT * FROM ({JUDGEMENTS}) WHERE frame_id % 50 = 0), f AS (SELECT lang AS recording_id, doc_id AS frame_id FROM documents WHERE doc_id % 3 <> 0),
    x AS (SELECT j.*, count(*) OVER (PARTITION BY j.recording_id, j.frame_id) AS copies, f.frame_id IS NOT NULL AS known FROM j LEFT JOIN f ON j.recording_id = f.recording_id AND j.frame_id = f.frame_id)
    SELECT DISTINCT recording_id, frame_id AS row_id, unnest(list_filter([CASE WHEN NOT known THEN 'unknown_frame' END, CASE WHEN copies > 1 THEN 'duplicate' END, CASE WHEN medium = 'poster' THEN 'medium' END,
        CASE WHEN trim(reason) = '' THEN 'reason' END,
        CASE WHEN is_meaningful AND (medium = 'speaker' OR trim(coalesce(semantic_key, '')) = '' OR quality_score IS NULL OR quality_score NOT BETWEEN 1 AND 5 OR content_summary = '') THEN 'meaningful' END,
        CASE WHEN NOT is_meaningful AND (semantic_key IS NOT NULL OR quality_score IS NOT NULL) THEN 'not_meaningful' END], lambda r: r IS NOT NULL)) AS rule FROM x
    UNION ALL SELECT recording_id, frame_id, 'missing' FROM f ANTI JOIN j USING (recording_id, frame_id)
""")
def judgement_violations(t: Tables) -> DataFrame:
    d, useful = F.col("doc_id"), F.col("toxic") == 0
    rows = t.raw("documents").join(t.raw("labels"), "doc_id").select(
        F.col("lang").alias(KEY), d.alias("frame_id"), F.when(d % 6 == 0, "ppt").when(d % 6 == 1, "speaker").when(d % 6 == 2, "poster").otherwise("chart").alias("medium"), useful.alias("is_meaningful"),
        F.when(d % 10 == 0, " ").otherwise("seen").alias("reason"), F.when(useful | (d % 4 == 0), F.col("source")).alias("semantic_key"),
        F.when(useful, F.col("quality") * 3 + (d % 4).cast("int")).alias("quality_score"), F.when(d % 12 == 5, "").otherwise(F.col("source")).alias("content_summary"),
    )
    frames = t.raw("documents").where(d % 3 != 0).select(F.col("lang").alias(KEY), d.alias("frame_id"))
    return validate.judgement_violations(rows.unionByName(rows.where("frame_id % 50 = 0")), frames)


@query(f"""
    WITH r AS (SELECT recording_id, seq, seq AS id, start + CASE WHEN seq % 6 = 5 THEN 3 ELSE 1 END AS start, stop, CASE WHEN seq % 10 = 9 THEN ' ' ELSE text END AS text FROM ({b.LINES}) WHERE NOT (recording_id % 4 = 0 AND seq = 2)),
    a AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS pos FROM r), m AS (SELECT *, seq AS m_id, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS pos FROM ({b.LINES})),
    x AS (SELECT coalesce(a.recording_id, m.recording_id) AS recording_id, coalesce(a.seq, m.pos) AS seq, a.id, a.start, a.stop, a.text, m.m_id, m.start AS m_start, m.stop AS m_stop
          FROM a FULL JOIN m ON a.recording_id = m.recording_id AND a.pos = m.pos)
    SELECT recording_id, seq AS row_id, 'count' AS rule FROM x WHERE id IS NULL OR m_id IS NULL
    UNION ALL SELECT recording_id, seq, 'id' FROM x WHERE id <> m_id
    UNION ALL SELECT recording_id, seq, 'drift' FROM x WHERE abs(start - m_start) > 2 OR abs(stop - m_stop) > 2
    UNION ALL SELECT recording_id, seq, 'blank' FROM x WHERE id IS NOT NULL AND trim(text) = ''
""")
def refined_violations(t: Tables) -> DataFrame:
    lines, seq = t.lines(), F.col("seq")
    refined = lines.where(~((F.col(KEY) % 4 == 0) & (seq == 2))).select(
        KEY, "seq", seq.alias("id"), (F.col("start") + F.when(seq % 6 == 5, 3).otherwise(1)).alias("start"), "stop", F.when(seq % 10 == 9, " ").otherwise(F.col("text")).alias("text")
    )
    return validate.refined_violations(refined, lines.select(KEY, "seq", seq.alias("id"), "start", "stop"), drift=2)


@query(f"""
    WITH x AS (SELECT *, last_value(CASE WHEN seq % 4 <> 2 THEN stop END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({BENT}))
    SELECT recording_id, seq AS row_id, 'interval' AS rule FROM x WHERE start >= stop UNION ALL SELECT recording_id, seq, 'order' FROM x WHERE start < before
""")
def speech_violations(t: Tables) -> DataFrame:
    return validate.speech_violations(_bent(t).withColumn("text", F.when(F.col("seq") % 4 == 2, "").otherwise("x")))


@query(f"""
    WITH x AS (SELECT recording_id, seq, seq AS id, [seq - 1, CASE WHEN seq % 6 = 5 THEN seq + 1 ELSE 0 END] AS refs, [seq - 1, CASE WHEN seq % 8 = 7 THEN 1 ELSE 0 END] AS marks FROM ({b.LINES}) WHERE seq > 0)
    SELECT recording_id, seq AS row_id, 'range' AS rule FROM x WHERE len(list_filter(refs, lambda r: r < 0 OR r >= id)) > 0
    UNION ALL SELECT recording_id, seq, 'marks' FROM x WHERE list_sort(list_distinct(refs)) <> list_sort(list_distinct(marks))
""")
def ref_violations(t: Tables) -> DataFrame:
    seq = F.col("seq")
    mark = lambda n: F.concat(F.lit("[[REF:"), n.cast("string"), F.lit("]]"))
    rows = t.lines().where("seq > 0").select(
        KEY, "seq", seq.alias("id"), F.array(seq - 1, F.when(seq % 6 == 5, seq + 1).otherwise(0)).alias("cross_refs"), F.concat(F.lit("see "), mark(seq - 1), F.lit(" and "), mark(F.when(seq % 8 == 7, 1).otherwise(0))).alias("text")
    )
    return validate.reference_violations(rows)


@query(f"""
    SELECT recording_id, chapter_id FROM ({b.CHAPTERS}) ANTI JOIN (SELECT o_custkey AS recording_id, o_orderkey AS chapter_id FROM orders WHERE o_orderstatus <> 'P') USING (recording_id, chapter_id)
""")
def missing_sections(t: Tables) -> DataFrame:
    done = t.raw("orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias(KEY), F.col("o_orderkey").alias("chapter_id"))
    return validate.missing_sections(t.chapters(), done)


# ---------------------------------------------------------------- text


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms, printf('%02d:%02d', s // 60, s % 60) AS mmss FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def render_times(t: Tables) -> DataFrame:
    return t.events().select("event_id", fn.hms(F.col("value") * 60).alias("hms"), fn.mmss(F.col("value") * 60).alias("mmss"))


@query("""
    SELECT conv_id, turn, 'at ' || printf('[%02d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60) || ' then ' || printf('[%02d:%02d:%02d]', u // 3600, u % 3600 // 60, u % 60) || ' ' || text AS text
    FROM (SELECT *, turn * 977 AS s, turn * 31 AS u FROM conversations)
""")
def render_ts_marks(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("at [[TS:"), (F.col("turn") * 977).cast("string"), F.lit(".250-9999.5]] then [[TS:"), (F.col("turn") * 31).cast("string"), F.lit("]] "), "text")
    return t.raw("conversations").select("conv_id", "turn", fn.render_time_marks(marked).alias("text"))


@query("""
    WITH a AS (SELECT conv_id, turn, 'chapter-' || turn || '-' || role AS anchor FROM conversations WHERE turn % 3 <> 2)
    SELECT c.conv_id, c.turn, c.text || ' see ' || CASE WHEN a.anchor IS NULL THEN '§' || (c.turn // 2 + 1) ELSE '[§' || (c.turn // 2 + 1) || '](#' || a.anchor || ')' END || '.' AS text
    FROM conversations c LEFT JOIN a ON c.conv_id = a.conv_id AND a.turn = c.turn // 2
""")
def ref_links(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    anchors = c.where("turn % 3 <> 2").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", F.concat(F.lit("chapter-"), F.col("turn").cast("string"), F.lit("-"), "role")))).alias("anchors"))
    marked = F.concat("text", F.lit(" see [[REF:"), F.floor(F.col("turn") / 2).cast("string"), F.lit("]]."))
    return c.join(anchors, "conv_id", "left").select("conv_id", "turn", fn.render_ref_marks(marked, F.coalesce("anchors", F.create_map().cast("map<bigint,string>"))).alias("text"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text ELSE '# other' || chr(10) || text END AS text FROM conversations")
def strip_headings(t: Tables) -> DataFrame:
    turn = F.col("turn") % 4
    head = F.when(turn == 0, F.concat(F.lit("\n## "), "role", F.lit("\n\n"))).when(turn == 1, F.concat(F.lit("# 3. "), "role", F.lit("\n"))).when(turn == 2, F.concat(F.lit("### "), "role", F.lit("\n"))).otherwise("# other\n")
    return t.raw("conversations").select("conv_id", "turn", fn.strip_heading(F.concat(head, "text"), F.col("role")).alias("text"))


@query("""
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '[00:01:02] ' || role || '.' WHEN 1 THEN '## ' || role || ' [00:01:02] .' WHEN 2 THEN '[00:01:02] a, [00:01:03] b' WHEN 3 THEN '[00:01:02]' WHEN 4 THEN '[01:02:03](u/' || turn || ') ' || role || '!'
        ELSE '[00:01:02] ' || role || chr(10) || chr(10) || 'x，y; z' END AS text FROM conversations
""")
def normalise_spacing(t: Tables) -> DataFrame:
    turn, role = F.col("turn") % 6, F.col("role")
    line = (
        F.when(turn == 0, F.concat(role, F.lit("[00:01:02] .  "))).when(turn == 1, F.concat(F.lit("## "), role, F.lit(" [00:01:02] . \t"))).when(turn == 2, F.lit("[00:01:02]a [00:01:03] , b".replace(" , b", "b").replace("]a ", "]a, ")))
        .when(turn == 3, "   [00:01:02]  ").when(turn == 4, F.concat(role, F.lit(" ![01:02:03](u/"), F.col("turn").cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("[00:01:02]"), role, F.lit("  \n \nx  ，y ; z")))
    )
    return t.raw("conversations").select("conv_id", "turn", fn.normalise_spacing(line).alias("text"))


@query(r"""
    SELECT page_id, 'chapter-' || page_id || CASE WHEN s = '' THEN '' ELSE '-' || s END AS anchor
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[\s\[\]()`*_{}<>#!|\\/?:;,.]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM pages)
""")
def chapter_anchors(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", fn.chapter_anchor(F.col("page_id"), F.col("url")).alias("anchor"))


@query(r"""
    SELECT page_id, CASE WHEN s = '' THEN 'note' ELSE s END AS stem
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace('Talk: ' || page_id || '? (v' || page_id % 3 || ')', '[\s\[\]()`*_{}<>#!|\\/?:;,.]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM pages)
""")
def output_stems(t: Tables) -> DataFrame:
    name = F.concat(F.lit("in/Talk: "), F.col("page_id").cast("string"), F.lit("? (v"), (F.col("page_id") % 3).cast("string"), F.lit(").mp4"))
    return t.raw("pages").select("page_id", fn.output_stem(name).alias("stem"))


@query("""
    SELECT doc_id, CASE WHEN NOT regexp_matches(d, '[A-Za-z0-9_中图]') THEN 'content' WHEN regexp_matches(d, '(?i)audio context|音频中') THEN 'audio' WHEN e = '' THEN 'evidence'
        WHEN doc_id % 2 = 0 AND NOT regexp_matches(v, '[A-Za-z0-9_看]') THEN 'visible_text' END AS verdict
    FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '...' WHEN 1 THEN 'the Audio Context says' WHEN 2 THEN '' WHEN 3 THEN '图' WHEN 4 THEN '音频中图' ELSE source END AS d, CASE WHEN doc_id % 11 IN (3, 4) THEN '' ELSE source END AS e,
                 CASE doc_id % 5 WHEN 0 THEN '--' WHEN 1 THEN '' WHEN 2 THEN '看不清' ELSE 'en' END AS v FROM documents WHERE source IS NOT NULL)
""")
def description_validity(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    said = F.when(d % 7 == 0, "...").when(d % 7 == 1, "the Audio Context says").when(d % 7 == 3, "图").when(d % 7 == 4, "音频中图").when(d % 7 != 2, F.col("source"))
    evidence = F.when(d % 11 != 4, F.array(F.lit(" "), F.when(d % 11 == 3, "\t").otherwise(F.col("source"))))
    seen = F.when(d % 5 == 0, "--").when(d % 5 == 2, "看不清").when(d % 5 > 2, "en")
    rows = t.raw("documents").where("source is not null").select("doc_id", said.alias("d"), evidence.alias("e"), seen.alias("v"), F.when(d % 2 == 0, "ppt").otherwise("demo").alias("m"))
    return rows.select("doc_id", fn.description_verdict(F.col("d"), F.col("v"), F.col("e"), F.col("m"), TEXT_MEDIA).alias("verdict"))


@query(f"""
    WITH l AS ({b.LINES}), n AS (SELECT recording_id, segment_id, printf('[%.3f-%.3f] %s', start / 8, stop / 8, text) AS line, seq FROM l)
    SELECT recording_id, string_agg(line, chr(10) ORDER BY seq) AS prompt FROM n GROUP BY recording_id
""")
def transcript_prompt(t: Tables) -> DataFrame:
    return notes.segment_lines(t.lines().select(KEY, "seq", (F.col("start") / 8).alias("start"), (F.col("stop") / 8).alias("stop"), "text"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def strict_json_decode(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    rows = files.strict_json(t.events().select("event_id", "props"), "props", T.StructType.fromDDL("k bigint"))
    return rows.where("error is null").select("event_id", "record.k")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def fenced_json(t: Tables) -> DataFrame:
    e = F.col("event_id") % 4
    text = F.when(e == 0, F.col("props")).when(e == 1, F.concat(F.lit("here:\n```json\n"), "props", F.lit("\n```\nbye"))).when(e == 2, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).otherwise("no json {")
    return t.events().select("event_id", F.get_json_object(fn.fenced_json(text), "$.k").cast("long").alias("k"))


@query("SELECT doc_id, length(text) // 4 + 1024 * (doc_id % 3) AS tokens FROM documents WHERE length(text) // 4 + 1024 * (doc_id % 3) > 1500")
def token_budget(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", admission.token_estimate(F.length("text"), F.col("doc_id") % 3).alias("tokens"))
    return admission.over_budget(rows, most=1500)


# ---------------------------------------------------------------- memo and admission


@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def content_hashes(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", memo.content_hash(F.col("html")).alias("content_hash"))


@query("SELECT item_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS prompt_hash FROM benchmark")
def prompt_hashes(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", memo.prompt_hash(F.concat("text", F.lit("  {# note\n #}"))).alias("prompt_hash"))


@query("""SELECT page_id, sha256('{"parts":{"config":"c' || chr(92) || '"1' || chr(92) || 'n","transcript":"' || sha256(html) || '"},"stage_name":"segment"}') AS cache_key FROM pages""")
def cache_keys(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", memo.cache_key("segment", {"transcript": memo.content_hash(F.col("html")), "config": F.lit('c"1\n')}).alias("cache_key"))


@query("""
    SELECT page_id % 10 AS shelf, sha256('[' || string_agg('{"hash":"' || sha256(html) || '","path":"' || url || '"}', ',' ORDER BY url, sha256(html)) || ']') AS hash FROM pages GROUP BY ALL
""")
def combined_hashes(t: Tables) -> DataFrame:
    rows = t.raw("pages").select((F.col("page_id") % 10).alias("shelf"), F.col("url").alias("path"), memo.content_hash(F.col("html")).alias("hash"))
    return memo.combined_hash(rows, ["shelf"])


def _requests(t: Tables, keep: str) -> DataFrame:
    return t.raw("orders").where(keep).select(F.col("o_custkey").alias(KEY), F.concat(F.lit("section_"), F.col("o_orderkey").cast("string")).alias("stage_name"), F.sha2(F.col("o_orderstatus"), 256).alias("cache_key"), F.array(F.col("o_orderpriority")).alias("output_paths"))


@query("SELECT o_custkey AS recording_id, 'section_' || o_orderkey AS stage_name FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P'")
def memo_hits(t: Tables) -> DataFrame:
    changed = _requests(t, "o_orderkey % 3 <> 0").withColumn("cache_key", F.when(F.col("cache_key") == F.sha2(F.lit("P"), 256), "old").otherwise(F.col("cache_key")))
    return memo.hits(_requests(t, "true"), changed).select(KEY, "stage_name")


@query("SELECT o_custkey AS recording_id, 'section_' || o_orderkey AS stage_name FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'P'")
def stale_chapters(t: Tables) -> DataFrame:
    changed = _requests(t, "o_orderkey % 3 <> 0").withColumn("cache_key", F.when(F.col("cache_key") == F.sha2(F.lit("P"), 256), "old").otherwise(F.col("cache_key")))
    return memo.stale(_requests(t, "true"), changed).select(KEY, "stage_name")


@query("""
    SELECT profile, t_us, tokens, count(*) OVER w AS window_requests, (sum(tokens) OVER w)::BIGINT AS window_tokens FROM (SELECT event_type AS profile, epoch_us(ts) AS t_us, floor(value)::BIGINT AS tokens FROM events)
    WINDOW w AS (PARTITION BY profile ORDER BY t_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)
""")
def rate_window_usage(t: Tables) -> DataFrame:
    rows = t.events().select(F.col("event_type").alias("profile"), F.col("us").alias("t_us"), F.floor("value").cast("long").alias("tokens"))
    return admission.usage(rows, window_us=HOUR)


@query("""
    WITH RECURSIVE q AS (SELECT event_type AS profile, event_id AS seq, (epoch_us(ts) // 60000000 - 28400000)::DOUBLE AS t, floor(value)::BIGINT AS tokens FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY t, seq) AS i FROM q),
    go AS (
      SELECT DISTINCT profile, 0::BIGINT AS i, 0::BIGINT AS seq, 0::DOUBLE AS t, -1e18::DOUBLE AS went, []::STRUCT(a DOUBLE, n BIGINT)[] AS log FROM r
      UNION ALL
      SELECT profile, i, seq, t, went, list_append(list_filter(log, lambda x: x.a > went - 60), {'a': went, 'n': tokens}) FROM (
        SELECT r.profile, r.i, r.seq, r.t, r.tokens, g.log, greatest(g.went, r.t, CASE WHEN len(g.log) >= 3 THEN g.log[len(g.log) - 2].a + 60 ELSE -1e18 END,
          CASE WHEN r.tokens <= 400 THEN coalesce(list_max(list_transform(list_filter(range(1, len(g.log) + 1), lambda j: list_sum(list_transform(g.log[j:], lambda x: x.n)) + r.tokens > 400), lambda j: g.log[j].a + 60)), -1e18) ELSE -1e18 END) AS went
        FROM go g JOIN r ON r.profile = g.profile AND r.i = g.i + 1))
    SELECT profile, seq, t, went AS admitted, went - t AS waited FROM go WHERE i > 0
""")
def admission_schedule(t: Tables) -> DataFrame:
    """Replay of a log under both limits; times are whole, so that sums are exact."""
    rows = t.events().select(F.col("event_type").alias("profile"), F.col("event_id").alias("seq"), (F.expr("us div 60000000") - 28400000).cast("double").alias("t"), F.floor("value").cast("long").alias("tokens"))
    return admission.schedule(rows, rpm=3, tpm=400)


# ---------------------------------------------------------------- files

PATHS = """
    SELECT CASE WHEN o_orderkey % 17 = 0 THEN '.hidden/' ELSE 'week' || o_orderkey % 5 || '/' END || 'talk' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.head-10m' ELSE '' END
           || CASE o_orderkey % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mp3' WHEN 2 THEN '.txt' ELSE '.webm' END AS path, o_orderkey % 13 = 0 AS is_symlink FROM orders"""


@query(f"""
    SELECT path, CASE WHEN lower(path) LIKE '%.mp3' THEN 'audio' ELSE 'video' END AS kind, string_split(path, '/')[1] AS folder,
           CASE WHEN lower(path) LIKE '%.mp3' THEN 'audio_only' ELSE 'multimodal' END AS mode
    FROM ({PATHS}) WHERE NOT is_symlink AND path NOT LIKE '.hidden%' AND path NOT LIKE '%.head-10m.%' AND path NOT LIKE '%.txt'
""")
def media_listing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(
        F.when(k % 17 == 0, ".hidden/").otherwise(F.concat(F.lit("week"), (k % 5).cast("string"), F.lit("/"))), F.lit("talk"), k.cast("string"), F.when(k % 7 == 0, ".head-10m").otherwise(""),
        F.when(k % 4 == 0, ".MP4").when(k % 4 == 1, ".mp3").when(k % 4 == 2, ".txt").otherwise(".webm"),
    )
    listed = files.media_listing(t.raw("orders").select(name.alias("path"), F.lit(False).alias("is_dir"), (k % 13 == 0).alias("is_symlink")))
    return files.run_mode(listed, multimodal=True)


@query("""
    WITH c AS (SELECT c_custkey AS k, 'dir' || c_custkey % 9 || '/note' || c_custkey AS base FROM customer),
    m AS (SELECT k, base || '-20260513-123456.md' AS path FROM c WHERE k % 2 = 0 AND k % 3 <> 0 UNION ALL SELECT k, base || '-20260513-123456_assets' FROM c WHERE k % 4 = 0 AND k % 3 <> 0)
    SELECT path, '_archive/' || path AS target, CASE WHEN path LIKE 'dir7/%' THEN 'parent_not_folder' WHEN k % 10 = 0 AND path LIKE '%.md' THEN 'target_exists' END AS conflict FROM m
""")
def tidy_plan(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    base = F.concat(F.lit("dir"), (k % 9).cast("string"), F.lit("/note"), k.cast("string"))
    stamped = F.concat(base, F.lit("-20260513-123456"))
    rows = t.raw("customer")
    named = lambda cond, path, is_dir: rows.where(cond).select(path.alias("path"), F.lit(is_dir).alias("is_dir"), F.lit(False).alias("is_symlink"))
    listing = named(k % 3 != 0, F.concat(base, F.lit(".md")), False)
    for more in (
        named(k % 2 == 0, F.concat(stamped, F.lit(".md")), False), named(k % 4 == 0, F.concat(stamped, F.lit("_assets")), True),
        named(k % 10 == 0, F.concat(F.lit("_archive/"), stamped, F.lit(".md")), False), named(k == 1, F.lit("_archive/dir7"), False),
    ):
        listing = listing.unionByName(more)
    return files.tidy_plan(listing)


@query("""
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN floor(value) WHEN event_id % 7 <> 0 THEN floor(value) + 1 END::DOUBLE AS duration, true AS has_audio, event_id % 5 <> 0 AS has_video, 'aac' AS audio_codec, 16000 AS sample_rate,
           CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 30000 / 1001::DOUBLE WHEN event_id % 4 = 2 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS fps, CASE WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'no_duration' END AS error FROM events
""")
def media_probe(t: Tables) -> DataFrame:
    e, whole = F.col("event_id"), F.floor("value").cast("long")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","avg_frame_rate":"'), F.when(e % 4 == 0, "30000/1001").when(e % 4 == 2, "").otherwise("0/0"), F.lit('","r_frame_rate":"25/1"},'))
    report = F.concat(
        F.lit('{"format":{"duration":"'), F.when(e % 3 == 0, "N/A").otherwise(whole.cast("string")), F.lit('"},"streams":['), F.when(e % 5 == 0, "").otherwise(video),
        F.lit('{"codec_type":"audio","codec_name":"aac","sample_rate":"16000","channels":1,"duration":"'), F.when(e % 7 == 0, "N/A").otherwise((whole + 1).cast("string")), F.lit('"}]}'),
    )
    return files.media_probe(t.events().select("event_id", report.alias("report"))).select("event_id", "duration", "has_audio", "has_video", "audio_codec", "sample_rate", "fps", "error")
