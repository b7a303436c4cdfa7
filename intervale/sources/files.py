"""File listings, media probes, strict JSON, and tidying of outputs, as queries over tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.functions.text import fraction, round3

# Media file extensions.
VIDEO = ("mp4", "mkv", "webm", "mov", "avi", "m4v")
AUDIO = ("mp3", "wav", "m4a", "flac", "aac", "ogg", "opus")


def read_files(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """Files below a root on any store Spark reads: path relative to it, length, modified, and content if wanted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace("path", "^.*?" + base.split("://")[-1].lstrip("/").replace(".", r"\."), "")
    return found.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), *([F.col("content")] if content else []))


def resolve_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, folder) of one media file, or of all media below a folder; raises where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise ValueError(f"no such input: {path}")
    if store.getFileStatus(where).isDirectory():
        found = media_listing(read_files(spark, path).select("path", F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink")))
        if not found.limit(1).count():
            raise ValueError(f"no media below {path}")
        return found
    one = spark.createDataFrame([(path,)], "path string")
    kind = F.when(extension(F.col("path")).isin(*VIDEO), "video").otherwise("audio")
    return one.select("path", kind.alias("kind"), F.lit("").alias("folder"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_head_trim(path: Column) -> Column:
    """A file that a head trim made: the stem ends with .head-<number> and maybe m."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "").rlike(r"\.head-[0-9.]+m?$")


def media_listing(files: DataFrame) -> DataFrame:
    """(path, is_dir, is_symlink) -> media files with kind and folder; no hidden parts, trims or links."""
    kind = F.when(extension(F.col("path")).isin(*VIDEO), "video").when(extension(F.col("path")).isin(*AUDIO), "audio")
    rows = files.where(~F.col("is_dir") & ~F.col("is_symlink") & ~is_hidden(F.col("path")) & ~is_head_trim(F.col("path"))).withColumn("kind", kind)
    return rows.where("kind is not null").select("path", "kind", F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", "").alias("folder"))


def run_mode(listing: DataFrame, *, multimodal: bool) -> DataFrame:
    """listing plus mode: multimodal if asked for and the file is a video, else audio_only."""
    return listing.withColumn("mode", F.when(F.lit(multimodal) & (F.col("kind") == "video"), "multimodal").otherwise("audio_only"))


# ---------------------------------------------------------------- probes and JSON

PROBE = (
    "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: int, width: int, height: int, "
    "avg_frame_rate: string, r_frame_rate: string, duration: string>>"
)


def media_probe(reports: DataFrame, column: str = "report") -> DataFrame:
    """Probe reports (JSON) -> first audio and video stream, and the first duration of format, audio, video; N/A is none.

    The frame rate is the average one, or the nominal one where there is none.
    What a stream doesn't say is ``unknown`` or 0; without a stream its columns
    are null and has_audio or has_video is false.  ``error`` is not_json or
    no_duration, else null.
    """
    r = reports.withColumn("p", F.from_json(column, PROBE))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    r = r.withColumns({"a": first("audio"), "v": first("video")})
    seconds = lambda c: round3(F.col(c).try_cast("double"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    of = lambda stream, value: F.when(F.col(stream).isNotNull(), value)
    zero = F.lit(0)
    return r.select(
        *reports.columns, F.coalesce(seconds("p.format.duration"), seconds("a.duration"), seconds("v.duration")).alias("duration"),
        F.col("a").isNotNull().alias("has_audio"), F.col("v").isNotNull().alias("has_video"),
        of("a", F.coalesce(given("a.codec_name"), F.lit("unknown"))).alias("audio_codec"), of("a", F.coalesce(F.col("a.sample_rate").try_cast("int"), zero)).alias("sample_rate"),
        of("a", F.coalesce("a.channels", zero)).alias("channels"), of("v", F.coalesce(given("v.codec_name"), F.lit("unknown"))).alias("video_codec"),
        of("v", F.coalesce("v.width", zero)).alias("width"), of("v", F.coalesce("v.height", zero)).alias("height"),
        of("v", fraction(F.coalesce(given("v.avg_frame_rate"), given("v.r_frame_rate"), F.lit("0/1")))).alias("fps"), F.col("p").isNull().alias("_lost"),
    ).withColumn("error", F.when(F.col("_lost"), "not_json").when(F.col("duration").isNull(), "no_duration")).drop("_lost")


# How a variant names the kinds of values that a type takes; whole numbers do for numbers.
_KINDS = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.DoubleType: "BIGINT|DECIMAL.*|DOUBLE|FLOAT"}


def _problem(value: Column, kind: T.DataType) -> Column:
    """Why a variant doesn't fit a type, or null: unknown_field, missing_field or bad_value, of the first place that breaks."""
    named = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        names, keys = F.array(*[F.lit(f.name) for f in kind.fields]), F.map_keys(held)
        inner = [_problem(F.try_element_at(held, F.lit(f.name)), f.dataType) for f in kind.fields]
        return F.when(value.isNull() | (named == "VOID"), None).when(~named.startswith("OBJECT"), "bad_value").when(F.size(F.array_except(keys, names)) > 0, "unknown_field").when(
            F.size(F.array_except(names, keys)) > 0, "missing_field").otherwise(F.coalesce(*inner))
    if isinstance(kind, T.ArrayType):
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _problem(x, kind.elementType))
        return F.when(value.isNull() | (named == "VOID"), None).when(~named.startswith("ARRAY"), "bad_value").otherwise(F.get(F.filter(items, lambda p: p.isNotNull()), F.lit(0)))
    if isinstance(kind, T.MapType):
        items = F.transform(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), lambda x: _problem(x, kind.valueType))
        return F.when(value.isNull() | (named == "VOID"), None).when(~named.startswith("OBJECT"), "bad_value").otherwise(F.get(F.filter(items, lambda p: p.isNotNull()), F.lit(0)))
    fits = named.rlike(f"^({_KINDS[type(kind)]})$")
    if isinstance(kind, T.IntegerType):
        fits = fits & F.try_variant_get(value, "$", "int").isNotNull()
    return F.when(value.isNull() | (named == "VOID") | fits, None).otherwise("bad_value")


def strict_json(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """rows plus ``record`` and ``error``: not_json, unknown_field, missing_field or bad_value.

    Unlike a plain decode it refuses, at every depth, fields the schema doesn't
    have, fields that are not there, and values it can't take; text is no number
    and a truth value is none either.  A field that is there and null is fine.
    """
    parsed = F.try_parse_json(column)
    whole = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "not_json").otherwise(_problem(parsed, schema))
    out = rows.withColumn("error", whole)
    return out.withColumn("record", F.when(F.col("error").isNull(), F.from_json(column, schema))).select(*rows.columns, "record", "error")


def read_strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed documents, one a file; raises where a file doesn't fit when that row is read."""
    rows = strict_json(spark.read.text(path, wholetext=True), "value", schema)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad document: "), F.col("error")))).otherwise(F.col("record"))
    return rows.select(checked.alias("record")).select("record.*")


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks, for hashes made on the driver."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=lambda s: sorted(s, key=lambda x: (type(x).__name__, repr(x))))


# ---------------------------------------------------------------- tidying

STAMPED = r"^(.+)-\d{8}-\d{6}$"


def tidy_plan(files: DataFrame, archive: str = "_archive") -> DataFrame:
    """Moves of stamped notes whose latest note exists: (path, target, conflict).

    files (path, is_dir, is_symlink).  ``x-YYYYMMDD-HHMMSS.md`` moves with its
    ``_assets`` below the root archive; only that one is skipped when scanning.
    conflict is assets_not_folder (a link or a file instead of the folder),
    parent_not_folder or target_exists, else null.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.md$", "")
    plain = files.select("path", "is_dir", "is_symlink")
    notes = plain.where(~F.col("is_dir") & ~F.col("is_symlink") & F.col("path").endswith(".md") & ~F.col("path").startswith(f"{archive}/"))
    notes = notes.select("path", folder.alias("folder"), stem.alias("stem"), F.regexp_extract(stem, STAMPED, 1).alias("base"))
    latest = notes.select("folder", F.col("stem").alias("base"))
    moved = notes.where("base <> ''").join(latest, ["folder", "base"], "left_semi")
    assets = plain.where(F.col("path").endswith("_assets")).select(F.col("path").alias("assets"), (~F.col("is_dir") | F.col("is_symlink")).alias("bad"))
    moves = moved.select("path", "folder", F.lit(False).alias("bad")).unionByName(
        moved.select(F.concat("folder", "stem", F.lit("_assets")).alias("assets"), "folder").join(assets, "assets").select(F.col("assets").alias("path"), "folder", "bad")
    )
    moves = moves.select("path", "bad", F.concat(F.lit(f"{archive}/"), "path").alias("target"), F.concat(F.lit(f"{archive}/"), "folder").alias("parent"))
    there = plain.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    blocked = plain.where(~F.col("is_dir") | F.col("is_symlink")).select(F.concat("path", F.lit("/")).alias("wall"))
    steps = moves.select("path", F.explode(F.transform(F.split(F.rtrim(F.col("parent"), F.lit("/")), "/"), lambda x, i: F.array_join(F.slice(F.split(F.col("parent"), "/"), 1, i + 1), "/"))).alias("step"))
    walls = steps.select("path", F.concat("step", F.lit("/")).alias("wall")).join(blocked, "wall", "left_semi").select("path", F.lit(True).alias("walled")).distinct()
    joined = moves.join(there, "target", "left").join(walls, "path", "left")
    conflict = F.when(F.col("bad"), "assets_not_folder").when(F.col("walled"), "parent_not_folder").when(F.col("there"), "target_exists")
    return joined.select("path", "target", conflict.alias("conflict"))


def apply_tidy(plan: DataFrame, root: str) -> int:
    """Carry out a plan below a folder and say how many moves it had; raises before the first one if there is a conflict.

    A plan has a row for each file that moves, which the driver takes one by one.
    """
    if plan.where("conflict is not null").limit(1).count():
        raise ValueError("the plan has conflicts")
    spark = plan.sparkSession
    jvm, moved = spark.sparkContext._jvm, 0
    at = lambda path: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    store = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in plan.orderBy("path").toLocalIterator():
        if store.exists(at(row.target)):
            raise ValueError(f"{row.target} is there already")
        store.mkdirs(at(row.target).getParent())
        if not store.rename(at(row.path), at(row.target)):
            raise OSError(f"{row.path} could not be moved")
        moved += 1
    return moved
