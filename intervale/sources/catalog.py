"""Where artifacts lie, which of them are there, and what is in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale import schemas
from intervale.functions.text import output_stem
from intervale.sources.files import strict_json

# Artifacts of one input below its cache folder, and the stage that makes each.
ARTIFACTS = {
    "audio_wav": ("audio/audio.wav", "extract"),
    "audio_extract_json": ("audio/extract.json", "extract"),
    "transcript_raw_json": ("transcript_raw.json", "transcribe"),
    "segments_json": ("segments.json", "segment"),
    "refined_dir": ("refined", "refine"),
    "refined_transcript_json": ("refined_transcript.json", "refine"),
    "visual_filter_frames_dir": ("visual/filter_frames", "visual_filter"),
    "visual_filtered_sample_json": ("visual/filtered_sample.json", "visual_filter"),
    "visual_semantic_frames_dir": ("visual/semantic_frames", "visual_semantic_filter"),
    "visual_semantic_sample_json": ("visual/semantic_sample.json", "visual_semantic_filter"),
    "visual_semantic_judgements_json": ("visual/semantic_judgements.json", "visual_semantic_filter"),
    "visual_alignments_json": ("visual/alignments.json", "visual_align"),
    "visual_descriptions_json": ("visual/descriptions.json", "visual_describe"),
    "content_blocks_json": ("content_blocks.json", "unify"),
    "outline_json": ("outline.json", "outline"),
    "sections_dir": ("sections", "section"),
    "debug_dir": ("debug", "debug"),
    "cache_note_md": ("note.md", "assemble"),
}
AUDIO_DONE, VISUAL_DONE = "refined_transcript_json", "visual_descriptions_json"


class MissingArtifact(FileNotFoundError):
    """An artifact whose stage has not run."""


def artifact_paths(inputs: DataFrame, *, cache: str, output: str) -> DataFrame:
    """inputs (path, input_hash, folder) plus a column for each artifact's path, and output_note_md.

    An input's cache folder is named by the hash of its content; its note keeps
    the input's own folder below the output.
    """
    run = F.concat(F.lit(f"{cache.rstrip('/')}/"), "input_hash")
    note = F.concat_ws("/", F.lit(output.rstrip("/")), F.when(F.col("folder") != "", F.col("folder")), F.concat(output_stem(F.col("path")), F.lit(".md")))
    columns = {name: F.concat(run, F.lit(f"/{path}")) for name, (path, _) in ARTIFACTS.items()}
    return inputs.withColumns({"run_dir": run} | columns | {"output_note_md": note})


def artifact_states(inputs: DataFrame, files: DataFrame, *, cache: str, output: str) -> DataFrame:
    """(path, input_hash, artifact, stage, there): each input's artifacts against a listing (path).

    The listing is gathered to a row for each run, which meets the inputs before
    they are taken apart.  It can be much larger than the planner takes it for,
    so it is never broadcast.
    """
    paths = artifact_paths(inputs, cache=cache, output=output).select("path", "input_hash", "run_dir")
    # None of these names is the end of another one, so a path belongs to one run.
    pattern = r"(?s)^(.*)/(" + "|".join(re.escape(p) for p, _ in ARTIFACTS.values()) + r")\z"
    made = files.select(F.regexp_extract("path", pattern, 1).alias("run_dir"), F.regexp_extract("path", pattern, 2).alias("p")).where("p <> ''")
    runs = made.groupBy("run_dir").agg(F.collect_set("p").alias("made"))  # so many artifacts at most
    there = lambda p: F.coalesce(F.array_contains("made", p), F.lit(False))
    states = F.array(*[F.struct(F.lit(n).alias("artifact"), F.lit(s).alias("stage"), there(p).alias("there")) for n, (p, s) in ARTIFACTS.items()])
    return paths.join(runs.hint("merge"), "run_dir", "left").select("path", "input_hash", F.explode(states).alias("a")).select("path", "input_hash", "a.*")


def completeness(states: DataFrame) -> DataFrame:
    """(input_hash, audio_complete, visual_complete, next_stage): the first stage in order whose artifacts aren't all there."""
    order = {s: i for i, s in enumerate(dict.fromkeys(s for _, s in ARTIFACTS.values()))}
    place = F.try_element_at(F.create_map(*(F.lit(x) for s, i in order.items() for x in (s, i))), "stage")
    done = lambda name: F.bool_or((F.col("artifact") == name) & F.col("there"))
    missing = F.when(~F.col("there") & (F.col("stage") != "debug"), F.struct(place.alias("i"), "stage"))
    return states.groupBy("input_hash").agg(done(AUDIO_DONE).alias("audio_complete"), done(VISUAL_DONE).alias("visual_complete"), F.min(missing).alias("m")).select(
        "input_hash", "audio_complete", "visual_complete", F.col("m.stage").alias("next_stage")
    )


def inspect(files: DataFrame, content: str = "content") -> DataFrame:
    """files (path, length, content) -> (path, kind, size, body): JSON and text as they are; of anything else only the size.

    JSON files of one folder that holds nothing else but numbered ones are one
    row: a list of their documents in name order.
    """
    text = F.col(content).cast("string")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".json"), "json").when(name.rlike(r"\.(md|txt)$"), "text").otherwise("binary")
    rows = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.when(kind != "binary", text).alias("body"))
    numbered = (F.col("kind") == "json") & F.col("name").rlike(r"^\d+\.json$")
    alone = rows.where(~numbered).select("path", "kind", "size", "body")
    parts = rows.where(numbered).groupBy("folder").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("name", "body"))).alias("b"))
    lists = parts.select(F.col("folder").alias("path"), F.lit("json").alias("kind"), "size", F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["body"]), ","), F.lit("]")).alias("body"))
    return alone.unionByName(lists)


class Catalog:
    """Typed tables of one run folder; a table is read when asked for, and an error names the stage that has not run."""

    TYPES = {
        "transcript_raw_json": schemas.TRANSCRIPT_SEGMENTS, "segments_json": schemas.MARKERS, "refined_transcript_json": schemas.REFINED_SEGMENTS,
        "visual_filtered_sample_json": schemas.FRAMES, "visual_semantic_sample_json": schemas.FRAMES, "visual_semantic_judgements_json": schemas.JUDGEMENTS,
        "visual_alignments_json": schemas.ALIGNMENTS, "visual_descriptions_json": schemas.DESCRIPTIONS, "content_blocks_json": schemas.CONTENT_BLOCKS, "outline_json": schemas.CHAPTERS,
    }

    def __init__(self, spark: SparkSession, run_dir: str):
        self.spark, self.run_dir, self._read = spark, run_dir.rstrip("/"), {}

    def exists(self, artifact: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.run_dir}/{ARTIFACTS[artifact][0]}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def table(self, artifact: str) -> DataFrame:
        """The rows of a JSON-lines artifact, strictly of its type; a row that doesn't fit is an error when it is read."""
        path, stage = ARTIFACTS[artifact]
        if artifact not in self._read:
            if not self.exists(artifact):
                raise MissingArtifact(f"{self.run_dir}/{path} is not there; has stage {stage} run?")
            rows = strict_json(self.spark.read.text(f"{self.run_dir}/{path}"), "value", T.StructType.fromDDL(self.TYPES[artifact]))
            checked: Column = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: "), F.col("error")))).otherwise(F.col("record"))
            self._read[artifact] = rows.select(checked.alias("record")).select("record.*")
        return self._read[artifact]

    def audio_complete(self) -> bool:
        return self.exists(AUDIO_DONE)

    def visual_complete(self) -> bool:
        return self.exists(VISUAL_DONE)
