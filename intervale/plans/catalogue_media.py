"""Queries of media, frames and speech over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions import frames as fr
from intervale.operators import selection, sequence
from intervale.plans import bindings as b
from intervale.plans.bindings import KEY, Tables
from intervale.plans.catalogue import query
from intervale.sources import media

# ---------------------------------------------------------------- times of frames

WINDOWS = "SELECT user_id AS recording_id, event_id AS window_id, event_id % 977 / 8::DOUBLE AS start, event_id % 977 / 8::DOUBLE + (1 + event_id % 7) / 4::DOUBLE AS stop FROM events"


def _windows(t: Tables) -> DataFrame:
    e = F.col("event_id")
    start = (e % 977).cast("double") / 8
    return t.events().select(F.col("user_id").alias(KEY), e.alias("window_id"), start.alias("start"), (start + (1 + e % 7).cast("double") / 4).alias("stop"))


@query(f"""
    SELECT DISTINCT recording_id, window_id, least(unnest(list_concat(list_transform(range(0, ceil((stop - start) * 2)::BIGINT), lambda i: start + i / 2::DOUBLE), [start + (stop - start) / 2, nextafter(stop, start)])), nextafter(stop, start)) AS t
    FROM ({WINDOWS})
""")
def candidate_times(t: Tables) -> DataFrame:
    return selection.candidate_times(_windows(t), fps=2.0).select(KEY, "window_id", F.explode("times").alias("t"))


@query(f"SELECT recording_id, window_id, start + (stop - start) / 2 AS middle, nextafter(stop, start) AS last FROM ({WINDOWS})")
def frame_times(t: Tables) -> DataFrame:
    middle = selection.frame_times(_windows(t), representative="middle").withColumnRenamed("ts", "middle")
    return selection.frame_times(middle, representative="last").select(KEY, "window_id", "middle", F.col("ts").alias("last"))


@query("""
    WITH f AS (SELECT label AS recording_id, vec_id AS frame, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
    SELECT recording_id, frame, round(CASE WHEN len(p) = len(e) THEN list_sum(list_transform(list_zip(p, e), lambda x: abs(x[1] - x[2]))) / len(e) ELSE 0 END, 9) AS score FROM f
""")
def change_scores(t: Tables) -> DataFrame:
    """Vectors of a label as the frames of a recording."""
    frames = t.raw("embeddings").select(F.col("label").alias(KEY), F.col("vec_id").alias("frame"), F.col("vec_id").alias("ts"), F.col("embedding").cast("array<double>").alias("feature"))
    return selection.change_scores(frames, block=64).select(KEY, "frame", F.round("score", 9).alias("score"))


SCORED = "SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) AS ts, floor(value) AS score FROM events"


@query(f"""
    WITH f AS ({SCORED}), e AS (SELECT recording_id, arg_min(ts, frame) AS first_ts, max(ts) AS last_ts FROM f GROUP BY recording_id),
    h AS (SELECT recording_id, list({{'f': frame, 't': ts, 's': score}} ORDER BY frame) AS xs FROM f WHERE score >= 60 GROUP BY recording_id),
    c AS (SELECT e.recording_id, thr AS threshold, last_ts, list_reduce(coalesce(xs, []), lambda acc, x: CASE WHEN x.s >= thr AND x.f - acc[-1].f >= 3 THEN list_append(acc, {{'f': x.f, 't': x.t, 's': 0::DOUBLE}}) ELSE acc END,
                 [{{'f': 0::BIGINT, 't': first_ts, 's': 0::DOUBLE}}]) AS cuts FROM e LEFT JOIN h USING (recording_id), (SELECT unnest([60::DOUBLE, 120::DOUBLE]) AS thr)),
    u AS (SELECT recording_id, threshold, last_ts, unnest(cuts) AS k FROM c),
    s AS (SELECT recording_id, threshold, k.t AS start, coalesce(lead(k.t) OVER (PARTITION BY recording_id, threshold ORDER BY k.f), last_ts) AS stop FROM u)
    SELECT * FROM s WHERE start < stop
""")
def scene_cuts(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    scored = t.events().select(F.col("user_id").alias(KEY), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("us").alias("ts"), F.floor("value").cast("double").alias("score"))
    return selection.scene_cuts(scored, thresholds=[60.0, 120.0], least_frames=3)


@query(f"""
    WITH d AS (SELECT recording_id, max(stop) / 10 AS duration FROM ({b.LINES}) GROUP BY recording_id), f AS (SELECT recording_id, unnest(range(0, ceil(duration / 4)::BIGINT)) AS frame FROM d),
    m AS (SELECT recording_id, marker_id AS time_id, start / 10 AS ts, ceil(start / 10 / 4)::BIGINT AS frame FROM ({b.MARKERS}))
    SELECT m.recording_id, time_id, ts, m.frame, f.frame * 4::DOUBLE AS shown FROM m LEFT JOIN f ON m.recording_id = f.recording_id AND m.frame = f.frame
""")
def frames_at(t: Tables) -> DataFrame:
    frames = sequence.fixed_rate_times(t.lines().groupBy(KEY).agg((F.max("stop") / 10).alias("duration")), fps=0.25)
    times = t.markers().select(KEY, F.col("marker_id").alias("time_id"), (F.col("start") / 10).alias("ts"))
    return selection.frames_at(times, frames.select(KEY, F.col("frame_id").cast("long").alias("frame"), F.col("ts").alias("shown")), fps=0.25).select(KEY, "time_id", "ts", "frame", "shown")


@query("""
    WITH f AS (SELECT user_id AS recording_id, event_id AS frame_id, event_id AS seq, epoch_us(ts) // 86400000000 AS ts FROM events WHERE value > 150),
    a AS (SELECT user_id AS recording_id, min(event_id) AS frame_id FROM events GROUP BY user_id)
    SELECT recording_id, ts, arg_min(frame_id, seq) AS frame_id, min(seq) AS seq FROM f GROUP BY recording_id, ts
    UNION ALL SELECT recording_id, 0, frame_id, 0 FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.recording_id = a.recording_id)
""")
def frames_or_first(t: Tables) -> DataFrame:
    e = t.events().select(F.col("user_id").alias(KEY), F.col("event_id").alias("frame_id"), F.col("event_id").alias("seq"), F.expr("us div 86400000000").alias("ts"), "value")
    return selection.distinct_times(e.where("value > 150").drop("value"), e.groupBy(KEY).agg(F.min("frame_id").alias("frame_id")))


DURATIONS = "SELECT user_id AS recording_id, 600000 + (user_id % 9) * 100000 AS duration FROM events GROUP BY user_id"


@query(f"""
    WITH s AS (SELECT user_id AS recording_id, h AS threshold, epoch_us(ts) // 1000000 - 1704067200 AS start, epoch_us(ts) // 1000000 - 1704067200 + 900 AS stop FROM events, (SELECT unnest([10, 15]) AS h) WHERE event_id % 50 < h AND user_id % 3 <> 0),
    i AS (SELECT recording_id, threshold, greatest(start, 0) AS start, least(stop, duration) AS stop FROM s JOIN ({DURATIONS}) USING (recording_id) WHERE greatest(start, 0) < least(stop, duration))
    SELECT recording_id, threshold, start::BIGINT AS start, stop::BIGINT AS stop FROM i
    UNION ALL SELECT recording_id, h, 0, duration FROM ({DURATIONS}) d, (SELECT unnest([10, 15, 20]) AS h) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.recording_id = d.recording_id AND i.threshold = h)
""")
def scenes_of_every_threshold(t: Tables) -> DataFrame:
    durations = t.events().select(F.col("user_id").alias(KEY)).distinct().select(KEY, (600000 + (F.col(KEY) % 9) * 100000).alias("duration"))
    rows = t.events().where("user_id % 3 <> 0").select(F.col("user_id").alias(KEY), "event_id", F.explode(F.array(F.lit(10), F.lit(15))).alias("threshold"), (F.expr("us div 1000000") - 1704067200).alias("start"))
    return selection.clamp_scenes(rows.where("event_id % 50 < threshold").select(KEY, "threshold", "start", (F.col("start") + 900).alias("stop")), durations, [10, 15, 20])


# ---------------------------------------------------------------- statistics of frames


def _grey(t: Tables) -> DataFrame:
    pixel = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.abs(x) * 1000).cast("int") % 256)
    return t.raw("embeddings").select("vec_id", pixel.alias("g"))


GREY = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(abs(x) * 1000)::BIGINT % 256) AS g FROM embeddings"
MEAN = "(len(v) * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) * list_sum(v))::DOUBLE / (len(v) * len(v))"


@query(f"""
    WITH f AS ({GREY}),
    m AS (SELECT vec_id, list_transform(range(0, 64), lambda i:
             g[CASE WHEN i // 8 = 0 THEN 1 ELSE i // 8 - 1 END * 8 + i % 8 + 1] + g[CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END * 8 + i % 8 + 1]
             + g[i // 8 * 8 + CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END + 1] + g[i // 8 * 8 + CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END + 1] - g[i + 1] * 4) AS v FROM f),
    c AS (SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, unnest(g) // 4 AS bin FROM f) GROUP BY vec_id, bin),
    e AS (SELECT vec_id, -sum(n / 64 * log2(n / 64)) / 6 AS entropy FROM c GROUP BY vec_id),
    s AS (SELECT vec_id, {MEAN} AS sharpness FROM m), k AS (SELECT vec_id, sqrt({MEAN}) / 255 AS contrast FROM (SELECT vec_id, g AS v FROM f))
    SELECT vec_id, round(entropy, 9) AS entropy, round(contrast, 9) AS contrast, round(sharpness, 6) AS sharpness FROM e JOIN s USING (vec_id) JOIN k USING (vec_id)
""")
def frame_statistics(t: Tables) -> DataFrame:
    g = F.col("g")
    return _grey(t).select("vec_id", F.round(fr.entropy(g), 9).alias("entropy"), F.round(fr.contrast(g), 9).alias("contrast"), F.round(fr.sharpness(g, F.lit(8)), 6).alias("sharpness"))


@query()
def frame_densities(t: Tables) -> DataFrame:
    """Edges that grow along ridges and wide blurs: checked against plain versions on small frames."""
    d = _grey(t).select("vec_id", fr.densities(F.col("g"), F.lit(8)).alias("d"))
    return d.select("vec_id", "d.*")


@query("""
    SELECT event_id, (a * 0.35::DOUBLE + b * 3::DOUBLE + c * 0.9::DOUBLE + d * 0.5::DOUBLE) * CASE WHEN b < 0.003::DOUBLE AND d < 0.03::DOUBLE THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS score
    FROM (SELECT event_id, event_id % 64 / 64::DOUBLE AS a, event_id % 32 / 1024::DOUBLE AS b, event_id % 8 / 8::DOUBLE AS c, event_id % 128 / 256::DOUBLE AS d FROM events)
""")
def content_scores(t: Tables) -> DataFrame:
    part = lambda m, n: (F.col("event_id") % m).cast("double") / n
    return t.events().select("event_id", fr.content_score(part(64, 64), part(32, 1024), part(8, 8), part(128, 256)).alias("score"))


# ---------------------------------------------------------------- speech and tools


@query("""
    SELECT event_id, dev AS device, CASE WHEN event_id % 5 = 0 THEN 'float32' WHEN dev = 'cuda' THEN 'float16' ELSE 'int8' END AS compute_type, event_id % 7 <> 0 AND dev = 'cuda' AS batched
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'cuda' ELSE 'cpu' END WHEN 1 THEN 'cpu' ELSE 'cuda' END AS dev FROM events)
""")
def device_choice(t: Tables) -> DataFrame:
    e = F.col("event_id")
    device = F.when(e % 3 == 0, "auto").when(e % 3 == 1, "cpu").otherwise("cuda")
    return t.events().select("event_id", media.speech_device(device, F.when(e % 5 == 0, "float32").otherwise("auto"), e % 7 != 0, has_gpu=e % 2 == 0).alias("d")).select("event_id", "d.*")


@query(f"""
    WITH x AS (SELECT recording_id, seq, printf('%.3f', start / 8 + 0.0005::DOUBLE)::DOUBLE AS start, printf('%.3f', stop / 8)::DOUBLE AS stop, CASE WHEN seq % 4 = 2 THEN '' ELSE trim(text) END AS text FROM ({b.LINES})),
    p AS (SELECT *, last_value(CASE WHEN text <> '' THEN stop END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_stop FROM x)
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS id FROM p WHERE text <> ''
""")
def normalised_speech(t: Tables) -> DataFrame:
    text = F.when(F.col("seq") % 4 == 2, " \t ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return media.normalise_speech(t.lines().select(KEY, "seq", (F.col("start").cast("double") / 8 + 0.0005).alias("start"), (F.col("stop").cast("double") / 8).alias("stop"), text.alias("text")))


@query("SELECT page_id AS recording_id, CASE WHEN page_id % 3 = 0 THEN 'en' ELSE 'zh' END AS language, CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id / 2 END::DOUBLE AS duration FROM pages")
def speech_headers(t: Tables) -> DataFrame:
    p = F.col("page_id")
    rows = t.raw("pages").select(p.alias(KEY), F.when(p % 3 == 0, "en ").when(p % 3 == 1, " ").alias("detected"), F.when(p % 4 != 0, p.cast("double") / 2).alias("duration"))
    return media.speech_header(rows, language="zh")


@query(r"SELECT page_id, 'v/talk.' || page_id || '.head-' || regexp_replace(printf('%.6f', page_id % 9 / 4::DOUBLE), '\.?0+$', '') || 'm.mp4' AS path FROM pages")
def trim_paths(t: Tables) -> DataFrame:
    p = F.col("page_id")
    return t.raw("pages").select("page_id", media.trim_path(F.concat(F.lit("v/talk."), p.cast("string"), F.lit(".mp4")), (p % 9).cast("double") / 4).alias("path"))
