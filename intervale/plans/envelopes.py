"""Requests with pictures: a column of parts, texts and pictures in the order in which a model gets them.

A part has a text, or a media type and the picture's bytes.  An envelope is
bounded: frames are dealt to as many requests as a budget of tokens asks for,
by running sums within blocks of time and over blocks, so pictures move
once and no recording has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators.admission import token_estimate

KEY = "recording_id"
PARTS = "array<struct<text: string, mime: string, content: binary>>"
#: Tokens of a picture in an estimate.
PICTURE_TOKENS = 1024


def text_part(text: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), F.lit(None).cast("string").alias("mime"), F.lit(None).cast("binary").alias("content"))


def picture_part(mime: Column, content: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("text"), mime.cast("string").alias("mime"), content.cast("binary").alias("content"))


def beside(prompt: Column, mime: Column, content: Column) -> Column:
    """Parts of a prompt and one picture; the prompt alone where there is no picture."""
    return F.when(content.isNull(), F.array(text_part(prompt))).otherwise(F.array(text_part(prompt), picture_part(mime, content)))


def pictures(parts: Column) -> Column:
    """How many parts are pictures."""
    return F.size(F.filter(parts, lambda p: p["content"].isNotNull()))


def text_length(parts: Column) -> Column:
    """Characters of all texts together."""
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0)))


def picture_envelopes(frames: DataFrame, *, prompt: Column, label: Column, most_tokens: int | None = None, block: float = 600.0) -> DataFrame:
    """frames (recording_id, frame_id, ts, mime, content) -> (recording_id, request, frame_ids, parts).

    The prompt, which has to be the same for all frames of a recording, then each
    frame's label and picture, by time and id; ids are unique in a recording.  Without ``most_tokens`` a
    recording is one request; with it, as many (from 0) as keep each at or under that
    estimate, but for a picture that is over it by itself.  ``block`` is a span of
    times that one task numbers at once.  A frame without a picture keeps its
    label; one without a time comes first.
    """
    cost = token_estimate(F.length("_label"), F.when(F.col("content").isNull(), 0).otherwise(1)) + 1  # lengths are rounded down part by part
    rows = frames.select(KEY, "frame_id", "ts", "mime", "content", prompt.alias("_prompt"), F.coalesce(label, F.lit("")).alias("_label"))
    if most_tokens is None:
        placed = rows.withColumn("request", F.lit(0).cast("long"))
    else:
        # A request takes the frames whose earlier costs lie in one stretch of ``room``: the last of them ends no later than
        # one greatest cost past it.
        sized = rows.withColumns({"_cost": cost, "_block": F.coalesce(F.floor(F.col("ts") / block).cast("long"), F.lit(-(2**62)))})
        blocks = sized.groupBy(KEY, "_block").agg(F.sum("_cost").alias("_all"), F.max("_cost").alias("_top"), F.max(F.length("_prompt")).alias("_asked"))
        every, up = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        fixed = token_estimate(F.max("_asked").over(every) + len("user"), F.lit(0)) + 1
        sums = blocks.select(KEY, "_block", F.coalesce(F.sum("_all").over(up), F.lit(0)).alias("_before"), F.greatest(F.lit(1), F.lit(most_tokens) - fixed - F.max("_top").over(every)).alias("_room"))
        inside = Window.partitionBy(KEY, "_block").orderBy("ts", "frame_id").rowsBetween(Window.unboundedPreceding, -1)
        # Only labels and ids are numbered; pictures are joined to their numbers afterwards.
        numbered = sized.select(KEY, "_block", "frame_id", "ts", F.coalesce(F.sum("_cost").over(inside), F.lit(0)).alias("_inside")).join(sums, [KEY, "_block"])
        stretch = numbered.select(KEY, "frame_id", F.floor((F.col("_before") + F.col("_inside")) / F.col("_room")).cast("long").alias("_stretch"))
        placed = rows.join(stretch, [KEY, "frame_id"]).withColumnRenamed("_stretch", "request")
    item = F.struct("ts", "frame_id", "_label", "mime", "content")
    made = placed.groupBy(KEY, "request").agg(F.max("_prompt").alias("_prompt"), F.array_sort(F.collect_list(item)).alias("_f"))
    shown = lambda f: F.filter(F.array(text_part(f["_label"]), picture_part(f["mime"], f["content"])), lambda p: p["text"].isNotNull() | p["content"].isNotNull())
    parts = F.concat(F.array(text_part(F.col("_prompt"))), F.flatten(F.transform("_f", shown)))
    return made.select(KEY, "request", F.transform("_f", lambda f: f["frame_id"]).alias("frame_ids"), parts.alias("parts"))
