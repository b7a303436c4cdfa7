"""Media tools and speech: commands for tools outside this environment, and what becomes of a recogniser's output."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.text import round3, strip, trim_label
from intervale.operators.sequence import in_order

KEY = "recording_id"


class MediaError(RuntimeError):
    """A media tool failed, or its output is no use."""


def run_tool(command: Sequence[str]) -> str:
    """The tool's output; raises with what it said where it can't be started or fails."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, check=False)
    except OSError as e:
        raise MediaError(f"{command[0]} can't be run: {e}") from e
    if done.returncode:
        raise MediaError(f"{command[0]} failed: {done.stderr.strip()}")
    return done.stdout


def wav_command(source: str, target: str, *, sample_rate: int, channels: int) -> list[str]:
    return ["ffmpeg", "-y", "-i", source, "-vn", "-ar", str(sample_rate), "-ac", str(channels), "-f", "wav", target]


def trim_command(source: str, target: str, *, minutes: float) -> list[str]:
    return ["ffmpeg", "-y", "-i", source, "-t", f"{minutes * 60:.3f}".rstrip("0").rstrip("."), "-c", "copy", target]


def make_file(target: str, command: Callable[[str], Sequence[str]], run: Callable[[Sequence[str]], str] = run_tool) -> None:
    """Run a command that writes a file, and put the file in its place only when it is whole and not empty."""
    folder = Path(target).parent
    folder.mkdir(parents=True, exist_ok=True)
    handle, made = tempfile.mkstemp(prefix=f".{Path(target).stem}.", suffix=Path(target).suffix, dir=folder)
    os.close(handle)
    try:
        run(command(made))
        if not os.path.getsize(made):
            raise MediaError(f"empty output for {target}")
        os.replace(made, target)
    finally:
        if os.path.exists(made):
            os.unlink(made)


def trim_path(path: Column, minutes: Column) -> Column:
    """Where the first minutes of a file go: ``x.head-10m.mp4``."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".head-"), trim_label(minutes), F.lit("m"), F.regexp_extract(path, r"(\.[^./]*)$", 1))


def speech_device(device: Column, compute: Column, batched: Column, *, has_gpu: Column) -> Column:
    """struct<device, compute_type, batched>: auto is a GPU if there is one; batches only on a GPU."""
    chosen = F.when(device == "auto", F.when(has_gpu, "cuda").otherwise("cpu")).otherwise(device)
    kind = F.when(compute == "auto", F.when(chosen == "cuda", "float16").otherwise("int8")).otherwise(compute)
    return F.struct(chosen.alias("device"), kind.alias("compute_type"), (batched & (chosen == "cuda")).alias("batched"))


def normalise_speech(segments: DataFrame) -> DataFrame:
    """A recogniser's segments as a transcript's: times to milliseconds, text trimmed, blank ones left out, dense ids.

    segments (recording_id, seq, start, stop, text).  ``previous_stop`` is the end
    of the last earlier segment with text, which rules look at (see
    ``validate.speech_violations``).
    """
    rows = segments.select(KEY, "seq", round3(F.col("start")).alias("start"), round3(F.col("stop")).alias("stop"), strip(F.col("text")).alias("text"))
    earlier = in_order().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous_stop", F.last(F.when(F.col("text") != "", F.col("stop")), ignorenulls=True).over(earlier))
    return rows.where("text <> ''").withColumn("id", (F.row_number().over(in_order()) - 1).cast("long"))


def speech_header(recordings: DataFrame, *, language: str) -> DataFrame:
    """recordings (recording_id, detected, duration) -> language, the configured one where none was found, and duration, 0 where unknown."""
    found = F.coalesce(F.when(strip(F.col("detected")) != "", strip(F.col("detected"))), F.lit(language))
    return recordings.select(KEY, found.alias("language"), F.coalesce(round3(F.col("duration")), F.lit(0.0)).alias("duration"))
