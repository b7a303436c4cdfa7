"""Operators over list order (``seq``) within a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"


def in_order() -> Window:
    return Window.partitionBy(KEY).orderBy("seq")


def batches(rows: DataFrame, *, size: int) -> DataFrame:
    """rows plus ``batch``: fixed-size runs of list order, numbered from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(in_order()) - 1) / size).cast("long"))


def valid_prefix(rows: DataFrame, is_valid: str = "is_valid") -> DataFrame:
    """The rows before each recording's first invalid one; a null counts as invalid."""
    bad = F.when(F.coalesce(F.col(is_valid), F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_bad", F.sum(bad).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).where("_bad = 0").drop("_bad")


def renumber(rows: DataFrame, keep: str) -> DataFrame:
    """The rows where ``keep`` holds, with dense ids from 0 in list order as ``new_id``."""
    return rows.where(keep).withColumn("new_id", (F.row_number().over(in_order()) - 1).cast("long"))


def previous_kept_end(rows: DataFrame, kept: str) -> DataFrame:
    """rows plus ``previous_end``: the stop of the last earlier row where ``kept`` holds."""
    last = F.last(F.when(F.expr(kept), F.col("stop")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("previous_end", last)


def progress(rows: DataFrame) -> DataFrame:
    """rows (.., stop, duration) plus ``done``: the running maximum of stop, never past the duration."""
    return rows.withColumn("done", F.max(F.least("stop", "duration")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def zip_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of equal position; ``left`` and ``right`` share only recording_id and seq."""
    numbered = lambda rows: rows.withColumn("_n", F.row_number().over(in_order()))
    return numbered(left).join(numbered(right).drop("seq"), [KEY, "_n"]).drop("_n")


def fixed_rate_times(recordings: DataFrame, *, fps: float) -> DataFrame:
    """A row for each sampled frame of a recording: frame_id from 0 and ts = frame_id / fps, below the duration."""
    count = F.ceil(F.col("duration") * fps).cast("int")
    rows = recordings.where(count > 0).select(KEY, F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_id"))
    return rows.withColumn("ts", F.col("frame_id") / F.lit(fps))


def head(rows: DataFrame, *, minutes: float) -> DataFrame:
    """Rows that start within the first minutes of their recording."""
    return rows.where(F.col("start") < minutes * 60)
