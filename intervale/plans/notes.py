"""Stages over tables: from segments, frames and sections to blocks and notes.

Stages that need a model take a client: any object with ``rows(frame) ->
frame`` (see ``intervale.plans.clients``).  All others are plain queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions import text as fn
from intervale.operators import intervals, validate

KEY = "recording_id"


def transcript_lines(segments: DataFrame) -> DataFrame:
    """(recording_id, seq, pos, line): a line for each word with a visible character, or for a segment without any."""
    words = segments.select(KEY, "seq", "start", "stop", "text", F.filter("words", lambda w: fn.strip(w["word"]) != "").alias("words"))
    line = lambda a, b, t: F.format_string("[%.3f-%.3f] %s", a, b, fn.strip(t))
    items = F.when(F.size("words") > 0, F.transform("words", lambda w: line(w["start"], w["stop"], w["word"]))).otherwise(F.array(line(F.col("start"), F.col("stop"), F.col("text"))))
    return words.select(KEY, "seq", F.posexplode(items).alias("pos", "line"))


def unify(refined: DataFrame, descriptions: DataFrame, *, mode: str, width: float) -> DataFrame:
    """Content blocks: refined segments with the visuals that overlap them; none in audio_only mode."""
    blocks = refined.withColumn("block_id", F.col("id"))
    visuals = descriptions.select(KEY, F.col("seq").alias("ord"), F.col("start").alias("v_start"), F.col("stop").alias("v_stop"), "image_path", "description", "medium", F.col("segment_id").alias("visual_segment_id"))
    slots = intervals.overlap_slots(blocks, visuals if mode == "multimodal" else visuals.where(F.lit(False)), width=width)
    nested = intervals.nest_slots(blocks, slots, ["slot_stop", "image_path", "description", "medium", "visual_segment_id"])
    slot = lambda v: F.struct(v["image_path"].alias("image_path"), v["description"].alias("description"), v["medium"].alias("medium"), v["slot_start"].alias("start"), v["slot_stop"].alias("stop"), v["visual_segment_id"].alias("visual_segment_id"))
    return nested.drop("block_id").withColumn("visuals", F.transform("visuals", slot))


def with_medium(alignments: DataFrame, judgements: DataFrame) -> DataFrame:
    """alignments plus the medium their frame was judged to be; a frame without a judgement is an error."""
    return validate.lookup(alignments, judgements, [KEY, "frame_id"], ["medium"], "judgement")


def describe_inputs(alignments: DataFrame, segments: DataFrame, *, width: float) -> DataFrame:
    """alignments plus the bounds and audio text of their segment; empty where the alignment is no context.

    An alignment to a segment that isn't there is an error.
    """
    bounds = validate.lookup(alignments, segments, [KEY, "segment_id"], ["start", "stop"], "segment").withColumn("window_id", F.col("frame_id"))
    texts = intervals.text_at(bounds.select(KEY, "window_id", "start", "stop"), segments, width=width)
    return bounds.join(texts.select(KEY, "window_id", F.col("text").alias("audio_text")), [KEY, "window_id"]).withColumn("audio_text", F.when(F.col("has_audio_context"), F.col("audio_text")).otherwise("")).drop("window_id")


def section_inputs(blocks: DataFrame, chapters: DataFrame, *, note: str | None = None) -> DataFrame:
    """(recording_id, chapter_id, blocks): each chapter's blocks in order, as the prompt shows them.

    With a note's path, images are links from it.
    """
    rows = intervals.chapter_blocks(chapters, blocks.withColumn("block_id", F.col("id")))
    visuals = F.col("visuals")
    if note is not None:
        visuals = F.transform("visuals", lambda v: v.withField("image_path", fn.markdown_image(F.lit(note), v["image_path"])))
    item = F.struct("block_id", F.format_string("%.3f", "start").alias("start"), F.format_string("%.3f", "stop").alias("stop"), "topic", "cleaned_text", "summary", visuals.alias("visuals"))
    return rows.groupBy(KEY, "chapter_id").agg(F.array_sort(F.collect_list(item)).alias("blocks"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """(recording_id, prompt): a line ``[start-stop] text`` for each segment, in list order."""
    line = F.format_string("[%.3f-%.3f] %s", F.col("start").cast("double"), F.col("stop").cast("double"), "text")
    rows = segments.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return rows.select(KEY, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


def front_matter(mode: Column, *, source_path: Column, duration: Column, generated_at: Column, profiles: dict[str, str]) -> Column:
    """The lines at the head of a note; the profiles that look at slides are ``null`` without a video."""
    seen = lambda task: F.when(mode == "multimodal", F.lit(profiles[task])).otherwise("null")
    tasks = [(t, F.lit(profiles[t])) for t in ("segment", "refine", "outline", "section")] + [(t, seen(t)) for t in ("slide_judge", "slide_describe")]
    lines = [
        F.lit("---"), F.concat(F.lit("source_path: "), source_path), F.concat(F.lit("duration: "), fn.hms(duration)), F.concat(F.lit("generated_at: "), generated_at),
        F.concat(F.lit("mode: "), mode), F.lit("llm_profiles:"), *[F.concat(F.lit(f"  {t}: "), p) for t, p in tasks], F.lit("---"),
    ]
    return F.concat_ws("\n", *lines)


def assemble(
    recordings: DataFrame,
    chapters: DataFrame,
    sections: DataFrame,
    *,
    profiles: dict[str, str],
    time_format: str = "[{hms}]",
    with_contents: bool = True,
    with_metadata: bool = True,
    url: str | None = None,
) -> DataFrame:
    """(recording_id, text): front matter, title, contents, and the sections in chapter order with their marks rendered.

    recordings (recording_id, source_path, title, duration, mode, generated_at as
    text), chapters (recording_id, chapter_id, seq, title, block_id_start,
    block_id_end), sections (recording_id, chapter_id, text).  A null title is the
    stem of the source's name.  A chapter without a section is an error.
    """
    anchored = chapters.withColumn("anchor", fn.chapter_anchor(F.col("chapter_id"), F.col("title")))
    of_block = intervals.block_chapters(anchored, "anchor")
    anchors = of_block.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.col("block_id").cast("long"), "anchor"))).alias("anchors"))
    sources = recordings.select(KEY, "source_path")
    body = validate.lookup(anchored, sections, [KEY, "chapter_id"], ["text"], "section").join(anchors, KEY, "left").join(sources, KEY)
    # A column a step: each is used more than once in the next one, and so is worked out before it.
    body = body.withColumn("_shown", fn.strip_heading(F.col("text"), F.col("title")))
    body = body.withColumn("_shown", fn.render_ref_marks(F.col("_shown"), F.coalesce("anchors", F.create_map().cast("map<bigint,string>"))))
    body = body.withColumn("_shown", fn.render_time_marks(F.col("_shown"), time_format, url, F.col("source_path")))
    shown = fn.strip(fn.normalise_spacing(F.col("_shown")))
    part = F.concat(F.lit('<a id="'), "anchor", F.lit('"></a>\n## '), "title", F.lit("\n"), shown, F.lit("\n"))
    entry = F.concat(F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")"))
    lists = body.select(KEY, "seq", part.alias("part"), entry.alias("entry")).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "part", "entry"))).alias("p"))
    joined = lists.select(KEY, F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("body"), F.array_join(F.transform("p", lambda x: x["entry"]), "\n").alias("contents"))
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    head = front_matter(F.col("mode"), source_path=F.col("source_path"), duration=F.col("duration"), generated_at=F.col("generated_at"), profiles=profiles) if with_metadata else None
    pieces = [*([F.concat(head, F.lit("\n"))] if with_metadata else []), F.concat(F.lit("# "), F.coalesce("title", stem), F.lit("\n")), *([F.concat("contents", F.lit("\n"))] if with_contents else []), F.col("body")]
    return recordings.join(joined, KEY).select(KEY, F.concat(F.regexp_replace(F.concat_ws("\n", *pieces), r"(?U)\s+\z", ""), F.lit("\n")).alias("text"))
