"""Sinks: tables and notes written whole or not at all, and a manifest of what was made.

Spark's committer moves finished files into place, so a lost executor or a
failed write leaves the target as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions import text as fn

KEY = "recording_id"


def write_table(rows: DataFrame, path: str, *, by_recording: bool = False) -> None:
    """Replace a table; with ``by_recording``, only the partitions of the recordings in ``rows``."""
    if by_recording:
        rows.repartition(KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames of recordings, numbered anew from 0 by time; what a recording had before goes."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(KEY).orderBy("ts")) - 1
    write_table(frames.withColumn("frame_id", n.cast("int")).withColumn("image_path", F.format_string("%06d.png", n + 1)), path, by_recording=True)


def write_segments(refined: DataFrame, path: str) -> None:
    """A JSON document for each refined segment, in a folder of its own id."""
    refined.repartition(KEY, "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY, "id").json(path)


def write_sections(sections: DataFrame, path: str) -> DataFrame:
    """Markdown of (recording_id, chapter_id, text) in a folder for each chapter; returns manifest rows of them."""
    sections.select(KEY, "chapter_id", "text").repartition(KEY, "chapter_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY, "chapter_id").text(path)
    name = F.concat(F.lit("section_"), F.col("chapter_id").cast("string"))
    where = F.concat(F.lit(f"{path}/{KEY}="), F.col(KEY).cast("string"), F.lit("/chapter_id="), F.col("chapter_id").cast("string"))
    return sections.select(KEY, name.alias("stage_name"), F.sha2("text", 256).alias("content_hash"), F.array(where).alias("output_paths"))


def _write_files(notes: DataFrame, path: str) -> None:
    """A file for each recording; the writer ends it with the line end that the text ends with."""
    rows = notes.select(KEY, F.regexp_replace("text", r"\n\z", "").alias("text"))
    rows.repartition(KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).text(path)


def write_notes(notes: DataFrame, path: str, *, stamp: str | None = None, from_cache: bool = False) -> None:
    """Notes (recording_id, text): the latest ones, a stamped copy beside them, and one to publish again from.

    With ``from_cache`` the notes are those of an earlier call, which only go out again.
    """
    for folder in ("latest", *([f"stamped/{stamp}"] if stamp else []), *([] if from_cache else ["cache"])):
        _write_files(notes, f"{path}/{folder}")


def cached_notes(spark, path: str) -> DataFrame:
    """The notes (recording_id, text) of the last call that wrote them."""
    return spark.read.text(f"{path}/cache", wholetext=True).select(KEY, F.col("value").alias("text"))


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_failures(rows: DataFrame, path: str) -> None:
    """Failed attempts (recording_id, stage_name, attempt, error_class, message, prompt, answer); never part of a manifest."""
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def append_progress(rows: DataFrame, path: str, *, stage: str) -> None:
    """(recording_id, done, total) of a stage, with the time; what a reader follows while it runs."""
    rows.select(KEY, F.lit(stage).alias("stage_name"), "done", "total", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def published_assets(blocks: DataFrame, *, note: Column, latest: Column, cache: str, resolved: str | None = None) -> DataFrame:
    """(recording_id, image_path, source, target, links): each distinct image of the blocks' visuals.

    ``note`` is the path of the note that gets the images and ``latest`` that of
    the latest note; ``resolved`` is the absolute name of the cache, links followed,
    where texts may hold that.  ``links`` maps every name a text may have for the image to
    the link to write: the bare path, the cached file, the link from either note
    and the cached file as seen from the note's folder.
    """
    images = blocks.select(KEY, note.alias("note"), latest.alias("latest"), F.explode("visuals.image_path").alias("image_path")).distinct()
    source = F.concat(F.lit(f"{cache.rstrip('/')}/"), "image_path")
    link = fn.markdown_image(F.col("note"), F.col("image_path"))
    names = F.array("image_path", source, link, fn.markdown_image(F.col("latest"), F.col("image_path")), fn.relative_path(source, fn.parent(F.col("note"))), *([F.concat(F.lit(f"{resolved.rstrip('/')}/"), "image_path")] if resolved else []))
    links = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, link)))
    return images.select(KEY, "image_path", source.alias("source"), fn.asset_path(F.col("note"), F.col("image_path")).alias("target"), links.alias("links"))


def published_notes(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """notes (recording_id, .., text) whose links lead to the published images, whatever name a link has for one; others stay."""
    links = assets.groupBy(KEY).agg(F.array_distinct(F.flatten(F.collect_list(F.map_entries("links")))).alias("_links"))
    found = notes.join(links, KEY, "left")
    return found.withColumn("text", F.when(F.col("_links").isNull(), F.col("text")).otherwise(fn.rewrite_links(F.col("text"), F.map_from_entries("_links")))).drop("_links")


def surviving_frames(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Frames that are kept, with the ids they have."""
    return frames.join(kept.select(KEY, "frame_id"), [KEY, "frame_id"], "left_semi")
