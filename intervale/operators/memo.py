"""Content-addressed results: keys, hits, what to recompute, and staged fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.functions.canonical import canonical_json

KEY = "recording_id"


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def prompt_hash(template: Column) -> Column:
    """Hash of a template without its comments and with white space collapsed."""
    bare = F.regexp_replace(template, r"(?s)\{#.*?#\}", "")
    return F.sha2(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")).cast("binary"), 256)


def json_hash(value: Column, kind: T.DataType) -> Column:
    """Hash of a value's canonical JSON."""
    return F.sha2(canonical_json(value, kind).cast("binary"), 256)


def cache_key(stage: str, parts: dict[str, Column]) -> Column:
    """Key of a stage's result: hash of the canonical JSON of its name and the hashes of all it depends on."""
    value = F.struct(F.struct(*[v.cast("string").alias(k) for k, v in parts.items()]).alias("parts"), F.lit(stage).alias("stage_name"))
    names = T.StructType([T.StructField(k, T.StringType()) for k in parts])
    return json_hash(value, T.StructType([T.StructField("parts", names), T.StructField("stage_name", T.StringType())]))


def combined_hash(files: DataFrame, group: list[str]) -> DataFrame:
    """(group, path, hash) -> one hash of each group's files: of the canonical JSON of their list in path order."""
    listed = F.array_sort(F.collect_list(F.struct("path", "hash")))
    return files.groupBy(*group).agg(json_hash(listed, T.ArrayType(T.StructType.fromDDL("path string, hash string"))).alias("hash"))


def hits(requests: DataFrame, manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Requests (recording_id, stage_name, cache_key, output_paths) that a manifest row answers: same key, same ordered paths.

    With ``files`` (path), all of the paths have to be there as well.
    """
    found = requests.join(manifest.select(KEY, "stage_name", "cache_key", "output_paths").distinct(), [KEY, "stage_name", "cache_key", "output_paths"], "left_semi")
    if files is None:
        return found
    wanted = found.select(KEY, "stage_name", F.explode("output_paths").alias("path"))
    lost = wanted.join(files.select("path"), "path", "left_anti").select(KEY, "stage_name").distinct()
    return found.join(lost, [KEY, "stage_name"], "left_anti")


def still_valid(hits: DataFrame, violations: DataFrame) -> DataFrame:
    """Hits whose cached rows break no rule: violations (recording_id, stage_name, ..) are of the rows as they are cached."""
    return hits.join(violations.select(KEY, "stage_name").distinct(), [KEY, "stage_name"], "left_anti")


def resume(partial: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of unfinished results (recording_id, cache_key, ..) to go on from, and those to purge.

    A row stays if its recording is requested with the key it was made under.
    """
    wanted = requests.select(KEY, "cache_key").distinct()
    return partial.join(wanted, [KEY, "cache_key"], "left_semi"), partial.join(wanted, [KEY, "cache_key"], "left_anti")


def section_counts(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """(recording_id, items, cached, jobs): how many results are asked for, known, and to be made."""
    known = hits.select(KEY, "stage_name").distinct().withColumn("known", F.lit(True))
    rows = requests.join(known, [KEY, "stage_name"], "left")
    return rows.groupBy(KEY).agg(F.count("*").alias("items"), F.count_if("known").alias("cached"), F.count_if(F.col("known").isNull()).alias("jobs"))


def stale(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """The requests that have to be computed."""
    return requests.join(manifest.select(KEY, "stage_name", "cache_key", "output_paths").distinct(), [KEY, "stage_name", "cache_key", "output_paths"], "left_anti")


def stale_closure(made: DataFrame, changed: DataFrame, *, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(recording_id, stage_name, depth): the changed results and all that were made from them, directly or not.

    made (recording_id, stage_name, inputs, outputs) says which files each result
    read and wrote, of whatever recording; ``depth`` is the least number of steps
    from a changed one.  A round a step: only what the last one reached is
    followed, and a result is followed once, however many ways lead to it, so
    shared inputs don't multiply and a circle ends.  ``settle`` keeps a round's rows.
    """
    wrote = made.select(F.col(KEY).alias("from_rec"), F.col("stage_name").alias("from_stage"), F.explode("outputs").alias("path"))
    read = made.select(KEY, "stage_name", F.explode("inputs").alias("path"))
    steps = settle(wrote.join(read, "path").select("from_rec", "from_stage", KEY, "stage_name").distinct())
    last = known = settle(changed.select(KEY, "stage_name").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not last.isEmpty():
        depth += 1
        ends = last.select(F.col(KEY).alias("from_rec"), F.col("stage_name").alias("from_stage"))
        reached = steps.join(ends, ["from_rec", "from_stage"], "left_semi").select(KEY, "stage_name").distinct()
        last = settle(reached.join(known, [KEY, "stage_name"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(last)
    return known


def fallback(rows: DataFrame, attempts: list[Callable[[DataFrame], DataFrame]], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pass rows through attempts in turn; each gives (key, .., is_valid).  Returns (accepted, left over).

    What an attempt leaves invalid or out goes to the next one.
    """
    accepted, left = None, rows
    for attempt in attempts:
        good = attempt(left).where("is_valid").drop("is_valid")
        accepted = good if accepted is None else accepted.unionByName(good)
        left = left.join(good.select(*key), key, "left_anti")
    return accepted, left


def retry(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: list[str], *, times: int) -> tuple[DataFrame, DataFrame]:
    """``fallback`` with the same attempt, which is told its number from 1."""
    return fallback(rows, [lambda left, n=n: attempt(left, n) for n in range(1, times + 1)], key)
