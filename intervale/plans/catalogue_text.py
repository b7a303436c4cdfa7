"""Queries of text functions, prompts, notes and paths over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.functions import text as fn
from intervale.operators import validate
from intervale.plans import bindings as b
from intervale.plans import notes
from intervale.plans.bindings import KEY, Tables
from intervale.plans.catalogue import query
from intervale.sources import catalog, sinks

# ---------------------------------------------------------------- times and marks


def _half_milliseconds(t: Tables) -> DataFrame:
    return t.events().select("event_id", (F.col("event_id").cast("double") * F.lit(0.0005) + F.floor("value").cast("double")).alias("x"))


HALVES = "SELECT event_id, event_id::DOUBLE * 0.0005::DOUBLE + floor(value) AS x FROM events"


@query(f"SELECT event_id, printf('%.3f', x)::DOUBLE AS seconds FROM ({HALVES})")
def rounded_seconds(t: Tables) -> DataFrame:
    return _half_milliseconds(t).select("event_id", fn.round3(F.col("x")).alias("seconds"))


@query(f"""
    SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || ' ' || printf('%02d:%02d', s // 60, s % 60) || ' ' || r || ' ' || s AS shown
    FROM (SELECT event_id, r, floor(r::DOUBLE)::BIGINT AS s FROM (SELECT event_id, printf('%.3f', x) AS r FROM ({HALVES})))
""")
def time_templates(t: Tables) -> DataFrame:
    return _half_milliseconds(t).select("event_id", fn.render_time(F.col("x"), "{hms} {mmss} {seconds} {seconds_int}").alias("shown"))


@query("""
    SELECT conv_id, turn, 'at [' || r || '](v/talk.mp4?t=' || u || '&of=talk.mp4) and [1.500](v/talk.mp4?t=1&of=talk.mp4)' AS text
    FROM (SELECT conv_id, turn, printf('%.3f', x) AS r, floor(x)::BIGINT AS u FROM (SELECT conv_id, turn, (turn * 60 + 59 || '.9996')::DOUBLE AS x FROM conversations))
""")
def linked_ts_marks(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("at [[TS:"), (F.col("turn") * 60 + 59).cast("string"), F.lit(".9996]] and [[TS:1.5-2]]"))
    linked = fn.render_time_marks(marked, "{seconds}", "{source_path}?t={seconds_int}&of={source_filename}", F.lit("v/talk.mp4"))
    return t.raw("conversations").select("conv_id", "turn", linked.alias("text"))


@query("SELECT event_id, printf('%.3f', (event_id || '.' || (event_id % 10000))::DOUBLE)::DOUBLE AS seconds FROM events")
def parsed_marks(t: Tables) -> DataFrame:
    e = F.col("event_id")
    mark = F.concat(F.lit("[[TS:"), e.cast("string"), F.lit("."), (e % 10000).cast("string"), F.lit("]]"))
    return t.events().select("event_id", fn.parse_time_mark(mark).alias("seconds"))


@query(r"SELECT event_id, regexp_replace(printf('%.6f', event_id % 97 / 8::DOUBLE), '\.?0+$', '') AS label FROM events")
def trim_labels(t: Tables) -> DataFrame:
    return t.events().select("event_id", fn.trim_label((F.col("event_id") % 97).cast("double") / 8).alias("label"))


# ---------------------------------------------------------------- links and paths


@query("""
    SELECT conv_id, turn, '![a](new/' || CASE turn % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END || '.png) and (old' || turn % 3 || ') ' || text AS text FROM conversations
""")
def link_rewrites(t: Tables) -> DataFrame:
    n = (F.col("turn") % 3).cast("string")
    linked = F.concat(F.lit("![a](old"), F.when(F.col("turn") % 3 == 0, "10").otherwise(n), F.lit(") and (old"), n, F.lit(") "), "text")
    links = F.create_map(*map(F.lit, ("old1", "new/x.png", "old2", "new/y.png", "old10", "new/z.png")))
    return t.raw("conversations").select("conv_id", "turn", fn.rewrite_links(linked, links).alias("text"))


@query("SELECT page_id, 'data:image/png;base64,' || base64(encode(html)) AS url FROM pages")
def data_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", fn.data_url(F.encode("html", "utf-8"), F.lit("image/png")).alias("url"))


@query("SELECT page_id, page_id % 5 < 3 AS is_local FROM pages")
def local_endpoints(t: Tables) -> DataFrame:
    p = F.col("page_id") % 5
    url = F.when(p == 0, "http://LocalHost:8000/v1").when(p == 1, "https://127.0.0.1/x").when(p == 2, "http://[::1]:8/").when(p == 3, F.col("url"))
    return t.raw("pages").select("page_id", fn.is_local_endpoint(url).alias("is_local"))


PATHS = "CASE page_id % 6 WHEN 0 THEN 'a/b.png' WHEN 1 THEN '/a/b.png' WHEN 2 THEN '../b.png' WHEN 3 THEN 'a/../b.png' WHEN 4 THEN 'a..b/c..png' ELSE 'a/..' END"


@query(rf"SELECT page_id, NOT (p LIKE '/%' OR regexp_matches(p, '(^|/)\.\.(/|$)')) AS contained FROM (SELECT page_id, {PATHS} AS p FROM pages)")
def contained_paths(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", fn.is_contained(F.expr(PATHS)).alias("contained"))


@query("""
    SELECT event_id, 'out/week/n' || event_id || '-' || strftime(ts + INTERVAL 9 HOUR, '%Y%m%d-%H%M%S') || '.md' AS note, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS made,
           'out/week/n' || event_id || '_assets' AS folder, 'out/week/n' || event_id || '_assets/' || event_id % 9 || '.png' AS asset, 'n' || event_id || '_assets/' || event_id % 9 || '.png' AS link,
           '../../cache/' || event_id % 9 || '.png' AS seen
    FROM events
""")
def stamped_paths(t: Tables) -> DataFrame:
    e, at = F.col("event_id").cast("string"), F.col("ts").cast("timestamp")
    note = F.concat(F.lit("out/week/n"), e, F.lit(".md"))
    image = F.concat(F.lit("frames/"), (F.col("event_id") % 9).cast("string"), F.lit(".png"))
    cached = F.concat(F.lit("cache/"), (F.col("event_id") % 9).cast("string"), F.lit(".png"))
    return t.events().select(
        "event_id", fn.stamped(note, fn.file_stamp(at, "Asia/Tokyo")).alias("note"), fn.iso_stamp(at).alias("made"), fn.assets_folder(note).alias("folder"),
        fn.asset_path(note, image).alias("asset"), fn.markdown_image(note, image).alias("link"), fn.relative_path(cached, fn.parent(note)).alias("seen"),
    )


_ARTIFACT_SQL = ", ".join(f"'cache/' || h || '/{path}' AS {name}" for name, (path, _) in catalog.ARTIFACTS.items())


@query(f"""
    SELECT k, 'cache/' || h AS run_dir, {_ARTIFACT_SQL}, 'notes/' || CASE WHEN k % 2 = 0 THEN 'week' || k % 3 || '/' ELSE '' END || 'Talk-' || k || '-x.md' AS output_note_md
    FROM (SELECT c_custkey AS k, sha256(c_name) AS h FROM customer)
""")
def artifact_paths(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    folder = F.when(k % 2 == 0, F.concat(F.lit("week"), (k % 3).cast("string"))).otherwise("")
    path = F.concat_ws("/", F.when(folder != "", folder), F.concat(F.lit("Talk "), k.cast("string"), F.lit(": x?.mp4")))
    inputs = t.raw("customer").select(k.alias("k"), path.alias("path"), F.sha2("c_name", 256).alias("input_hash"), folder.alias("folder"))
    return catalog.artifact_paths(inputs, cache="cache/", output="notes").drop("path", "input_hash", "folder")


@query(r"""
    SELECT page_id, lost FROM (SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'frame' WHEN 3 THEN 'x' WHEN 4 THEN 'a,b' ELSE '' END AS lost FROM pages)
""")
def template_fields(t: Tables) -> DataFrame:
    p = F.col("page_id") % 5
    template = F.when(p == 0, "[{hms}]").when(p == 1, "{seconds}s {mmss:>5}").when(p == 2, "{frame} {hms}").when(p == 3, "{{hms}} {x}").otherwise("{b}{a}{seconds_int}")
    return t.raw("pages").select("page_id", F.array_join(fn.unknown_fields(template, ("hms", "mmss", "seconds", "seconds_int")), ",").alias("lost"))


# ---------------------------------------------------------------- prompts and notes


@query("SELECT doc_id, 'Document ' || doc_id || ' (' || coalesce(lang, '') || ')' || chr(10) || coalesce(text, '') || chr(10) AS prompt FROM documents")
def rendered_prompts(t: Tables) -> DataFrame:
    template = "Document {{ doc_id }} ({{lang}}){# not for\n the model #}\n{{ text }}\n"
    return t.raw("documents").select("doc_id", fn.render_prompt(template, {c: F.col(c) for c in ("doc_id", "lang", "text")}).alias("prompt"))


@query(f"""
    WITH l AS ({b.LINES}), w AS ({b.WORDS}),
    x AS (SELECT recording_id, segment_id, start, stop, trim(word) AS t, word_pos AS p FROM w WHERE trim(word) <> ''
          UNION ALL SELECT recording_id, segment_id, start, stop, trim(text), 0 FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.recording_id = l.recording_id AND w.segment_id = l.segment_id AND trim(word) <> ''))
    SELECT recording_id, segment_id AS seq, (row_number() OVER (PARTITION BY recording_id, segment_id ORDER BY p) - 1)::INT AS pos, printf('[%.3f-%.3f] %s', start / 10, stop / 10, t) AS line FROM x
""")
def prompt_lines(t: Tables) -> DataFrame:
    w = t.words().groupBy(KEY, "segment_id").agg(F.array_sort(F.collect_list(F.struct("word_pos", "word", (F.col("start") / 10).alias("start"), (F.col("stop") / 10).alias("stop")))).alias("words"))
    lines = t.lines().join(w, [KEY, "segment_id"], "left").withColumn("words", F.coalesce("words", F.array().cast(w.schema["words"].dataType)))
    return notes.transcript_lines(lines.select(KEY, "seq", (F.col("start") / 10).alias("start"), (F.col("stop") / 10).alias("stop"), "text", "words"))


@query(f"""
    WITH l AS ({b.LINES})
    SELECT recording_id, segment_id AS frame_id, segment_id, start, stop, CASE WHEN segment_id % 3 <> 0 THEN trim(text) ELSE '' END AS audio_text FROM l
""")
def audio_context_texts(t: Tables) -> DataFrame:
    lines = t.lines().drop("role")
    frames = lines.select(KEY, "segment_id", F.col("segment_id").alias("frame_id"), (F.col("segment_id") % 3 != 0).alias("has_audio_context"))
    return notes.describe_inputs(frames, lines, width=500).select(KEY, "frame_id", "segment_id", "start", "stop", "audio_text")


@query("""
    SELECT d.lang AS recording_id, d.doc_id AS frame_id, CASE WHEN quality = 1 THEN 'ppt' ELSE 'demo' END AS medium FROM documents d JOIN labels USING (doc_id) WHERE d.lang IS NOT NULL
""")
def frame_media(t: Tables) -> DataFrame:
    rows = t.raw("documents").where("lang is not null").join(t.raw("labels"), "doc_id")
    frames = rows.select(F.col("lang").alias(KEY), F.col("doc_id").alias("frame_id"))
    judged = rows.select(F.col("lang").alias(KEY), F.col("doc_id").alias("frame_id"), F.when(F.col("quality") == 1, "ppt").otherwise("demo").alias("medium"))
    return notes.with_medium(frames, judged)


def _refined(t: Tables) -> DataFrame:
    return t.segments().select(KEY, "seq", F.col("segment_id").alias("id"), "start", "stop", F.lit("t").alias("topic"), F.lit("c").alias("cleaned_text"), F.lit("s").alias("summary"))


def _described(t: Tables) -> DataFrame:
    return t.frames().select(
        KEY, F.col("frame_id").alias("seq"), (F.col("frame_id") % 5).alias("segment_id"), (F.col("ts") - 4 * b.HOUR).alias("start"), (F.col("ts") + 4 * b.HOUR).alias("stop"),
        F.concat(F.lit("f/"), F.col("frame_id").cast("string"), F.lit(".png")).alias("image_path"), F.lit("d").alias("description"), F.lit("ppt").alias("medium"),
    )


VISUALS = f"SELECT recording_id, frame_id AS ord, ts - 14400000000 AS v_start, ts + 14400000000 AS v_stop FROM ({b.FRAMES})"


@query(f"""
    WITH x AS (SELECT s.recording_id, s.segment_id, s.start, s.stop, v.ord, greatest(s.start, v_start) AS a, least(s.stop, v_stop) AS z
               FROM ({b.SEGMENTS}) s LEFT JOIN ({VISUALS}) v ON s.recording_id = v.recording_id AND s.start < v_stop AND s.stop > v_start)
    SELECT 'multimodal' AS mode, recording_id, segment_id AS id, start, stop, coalesce(string_agg('f/' || ord || '.png@' || a || '-' || z || '/' || ord % 5, ' ' ORDER BY a, ord) FILTER (WHERE ord IS NOT NULL), '') AS slots
    FROM x GROUP BY recording_id, segment_id, start, stop
    UNION ALL SELECT 'audio_only', recording_id, segment_id, start, stop, '' FROM ({b.SEGMENTS})
""")
def content_blocks(t: Tables) -> DataFrame:
    shown = F.array_join(F.transform("visuals", lambda v: F.concat(v["image_path"], F.lit("@"), v["start"].cast("string"), F.lit("-"), v["stop"].cast("string"), F.lit("/"), v["visual_segment_id"].cast("string"))), " ")
    made = [notes.unify(_refined(t), _described(t), mode=mode, width=24 * b.HOUR).select(F.lit(mode).alias("mode"), KEY, "id", "start", "stop", shown.alias("slots")) for mode in ("multimodal", "audio_only")]
    return made[0].unionByName(made[1])


@query(f"""
    WITH c AS ({b.CHAPTERS}), x AS (SELECT c.recording_id, chapter_id, i FROM c JOIN (SELECT unnest(range(0, 8)) AS i) ON i BETWEEN block_id_start AND block_id_end)
    SELECT recording_id, chapter_id, string_agg(i || '@' || i || '.500:n_assets/' || i || '.png', ' ' ORDER BY i) AS blocks FROM x GROUP BY ALL
""")
def section_prompts(t: Tables) -> DataFrame:
    i = F.col("i")
    image = F.struct(F.concat(F.lit("f/"), i.cast("string"), F.lit(".png")).alias("image_path"))
    blocks = t.chapters().select(KEY).distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    blocks = blocks.select(KEY, i.alias("id"), (i + 0.5).alias("start"), (i + 1.0).alias("stop"), F.lit("t").alias("topic"), F.lit("c").alias("cleaned_text"), F.lit("s").alias("summary"), F.array(image).alias("visuals"))
    shown = F.array_join(F.transform("blocks", lambda x: F.concat(x["block_id"].cast("string"), F.lit("@"), x["start"], F.lit(":"), F.get(x["visuals"], F.lit(0))["image_path"])), " ")
    return notes.section_inputs(blocks, t.chapters(), note="out/n.md").select(KEY, "chapter_id", shown.alias("blocks"))


PROFILES = {task: f"p_{task}" for task in ("segment", "refine", "outline", "section", "slide_judge", "slide_describe")}


@query(r"""
    WITH c AS (SELECT o_custkey AS r, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    f AS (SELECT r, 'chapter-' || k || '-order-' || k || '-x' AS first FROM c WHERE n = 1),
    s AS (SELECT r, n, '- [Order ' || k || ' x](#chapter-' || k || '-order-' || k || '-x)' AS entry,
                 '<a id="chapter-' || k || '-order-' || k || '-x"></a>' || chr(10) || '## Order ' || k || ' x' || chr(10) || '[00:01:01] Body of ' || k || ' at  done' || chr(10) || 'see [§1](#' || first || ') or §100000.' || chr(10) AS part
          FROM c JOIN f USING (r)),
    j AS (SELECT r, string_agg(entry, chr(10) ORDER BY n) AS toc, string_agg(part, chr(10) ORDER BY n) AS body FROM s GROUP BY r)
    SELECT r AS recording_id, '---' || chr(10) || 'source_path: in/talk ' || r || '.mp4' || chr(10) || 'duration: ' || printf('%02d:%02d:%02d', r // 3600, r % 3600 // 60, r % 60) || chr(10) || 'generated_at: now' || chr(10)
        || 'mode: ' || CASE WHEN r % 2 = 0 THEN 'multimodal' ELSE 'audio_only' END || chr(10) || 'llm_profiles:' || chr(10) || '  segment: p_segment' || chr(10) || '  refine: p_refine' || chr(10) || '  outline: p_outline' || chr(10)
        || '  section: p_section' || chr(10) || '  slide_judge: ' || CASE WHEN r % 2 = 0 THEN 'p_slide_judge' ELSE 'null' END || chr(10) || '  slide_describe: ' || CASE WHEN r % 2 = 0 THEN 'p_slide_describe' ELSE 'null' END || chr(10)
        || '---' || chr(10) || chr(10) || '# ' || CASE WHEN r % 3 = 0 THEN 'Top' ELSE 'talk ' || r END || chr(10) || chr(10) || toc || chr(10) || chr(10) || regexp_replace(body, '\n+$', '') || chr(10) AS text
    FROM j
""")
def assembled_notes(t: Tables) -> DataFrame:
    chapters = t.chapters().withColumn("title", F.concat(F.lit("Order "), F.col("chapter_id").cast("string"), F.lit(" x")))
    body = F.concat(F.lit("\n## 3. "), "title", F.lit("\n\nBody of "), F.col("chapter_id").cast("string"), F.lit(" at [[TS:61.2-70]] done  \nsee [[REF:0]] or [[REF:99999]] ."))
    r = F.col(KEY)
    recordings = chapters.select(KEY).distinct().select(
        KEY, F.concat(F.lit("in/talk "), r.cast("string"), F.lit(".mp4")).alias("source_path"), F.when(r % 3 == 0, "Top").alias("title"), r.cast("double").alias("duration"),
        F.when(r % 2 == 0, "multimodal").otherwise("audio_only").alias("mode"), F.lit("now").alias("generated_at"),
    )
    return notes.assemble(recordings, chapters, chapters.select(KEY, "chapter_id", body.alias("text")), profiles=PROFILES)


# ---------------------------------------------------------------- images of notes


@query("""
    SELECT DISTINCT o_custkey AS recording_id, 'f/' || o_orderkey % 7 || '.png' AS image_path, 'cache/h/f/' || o_orderkey % 7 || '.png' AS source, 'out/a/n-20260101-000000_assets/' || o_orderkey % 7 || '.png' AS target,
           list_aggregate(list_sort(['f/' || x, 'cache/h/f/' || x, 'n-20260101-000000_assets/' || x, 'n_assets/' || x, '../../cache/h/f/' || x]), 'string_agg', '|') AS names, 'n-20260101-000000_assets/' || x AS link
    FROM (SELECT *, o_orderkey % 7 || '.png' AS x FROM orders)
""")
def published_assets(t: Tables) -> DataFrame:
    image = F.concat(F.lit("f/"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".png"))
    blocks = t.raw("orders").select(F.col("o_custkey").alias(KEY), F.array(F.struct(image.alias("image_path"))).alias("visuals"))
    made = sinks.published_assets(blocks, note=F.lit("out/a/n-20260101-000000.md"), latest=F.lit("out/a/n.md"), cache="cache/h")
    return made.select(KEY, "image_path", "source", "target", F.array_join(F.array_sort(F.map_keys("links")), "|").alias("names"), F.try_element_at("links", "image_path").alias("link"))


#: Every name that a text may have for image {0}, and a link that isn't one.
SPELLED = "![a](f/{0}) ![b](cache/h/f/{0}) ![c](/srv/v/cache/h/f/{0}) ![d](n_assets/{0}) ![e](n-20260101-000000_assets/{0}) ![f](../../cache/h/f/{0}) ![g](other/{0}) f/{0}"
PUBLISHED = re.sub(r"\((?!other)[^)]*\)", "(n-20260101-000000_assets/{0})", SPELLED)


@query(f"""
    SELECT recording_id, string_agg(replace('{PUBLISHED}', '{{0}}', x), chr(10) ORDER BY x) AS text FROM (SELECT DISTINCT o_custkey AS recording_id, o_orderkey % 7 || '.png' AS x FROM orders) GROUP BY recording_id
""")
def published_notes(t: Tables) -> DataFrame:
    """Notes whose links name their images in all ways, after publishing."""
    orders = t.raw("orders").select(F.col("o_custkey").alias(KEY), F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(".png")).alias("x"))
    blocks = orders.select(KEY, F.array(F.struct(F.concat(F.lit("f/"), "x").alias("image_path"))).alias("visuals"))
    notes = orders.distinct().groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.replace(F.lit(SPELLED), F.lit("{0}"), x)), "\n").alias("text"))
    assets = sinks.published_assets(blocks, note=F.lit("out/a/n-20260101-000000.md"), latest=F.lit("out/a/n.md"), cache="cache/h", resolved="/srv/v/cache/h")
    return sinks.published_notes(notes, assets)


@query("SELECT d.lang AS recording_id, doc_id AS frame_id FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0 AND lang IS NOT NULL")
def surviving_frames(t: Tables) -> DataFrame:
    frames = t.raw("documents").select(F.col("lang").alias(KEY), F.col("doc_id").alias("frame_id"))
    kept = t.raw("documents").join(t.raw("labels").where("toxic = 0"), "doc_id").select(F.col("lang").alias(KEY), F.col("doc_id").alias("frame_id"))
    return sinks.surviving_frames(frames, kept)


@query(f"""
    WITH w AS (SELECT recording_id, marker_id AS window_id, CASE WHEN marker_id % 4 = 0 THEN stop ELSE start END AS start, stop FROM ({b.MARKERS})),
    d AS (SELECT recording_id, max(stop) - 100 AS duration FROM ({b.LINES}) GROUP BY recording_id)
    SELECT recording_id, window_id, CASE WHEN start >= stop THEN 'reversed' ELSE 'outside' END AS rule FROM w JOIN d USING (recording_id) WHERE start >= stop OR start < 0 OR stop > duration
""")
def window_bounds(t: Tables) -> DataFrame:
    from intervale.operators import intervals

    m = F.col("marker_id")
    windows = t.markers().select(KEY, m.alias("window_id"), F.when(m % 4 == 0, F.col("stop")).otherwise(F.col("start")).alias("start"), "stop")
    return intervals.out_of_bounds(windows, t.lines().groupBy(KEY).agg((F.max("stop") - 100).alias("duration")))


@query(f"""
    SELECT recording_id, segment_id, CASE WHEN seq % 7 = 6 THEN 'en' ELSE 'zh' END AS language FROM ({b.LINES}) WHERE seq % 3 <> 1 AND EXISTS (SELECT 1)
""")
def segment_languages(t: Tables) -> DataFrame:
    lines = t.lines()
    table = lines.select(KEY, "segment_id", F.when(F.col("seq") % 7 == 6, "en").otherwise("zh").alias("language"))
    return validate.lookup(lines.where("seq % 3 <> 1").select(KEY, "segment_id"), table, [KEY, "segment_id"], ["language"], "language")
