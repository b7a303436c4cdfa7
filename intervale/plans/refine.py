"""Refining segments with a model: one request a recording, a batch or a segment, and from each to the next where one fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.operators import sequence, validate
from intervale.plans.clients import Client
from intervale.plans.completion import complete_json
from intervale.plans.config import Profile
from intervale.settling import settle

KEY = "recording_id"
#: The units of each mode, in the order in which they are tried.
MODES = {"single_call": ("recording",), "batched": ("batch",), "serial": ("segment",), "adaptive": ("recording", "batch", "segment")}
SEGMENTS = "segments array<struct<id: bigint, start: double, stop: double, topic: string, cleaned_text: string, summary: string, cross_refs: array<bigint>>>"


def _violations(refined: DataFrame, markers: DataFrame) -> DataFrame:
    rows = refined.withColumn("text", F.col("cleaned_text"))
    own = validate.refined_violations(rows, markers, drift=0.2)
    return own.select(KEY, "rule").unionByName(validate.reference_violations(rows).select(KEY, "rule")).distinct()


def refine(
    inputs: DataFrame, make_client: Callable[[], Client], profile: Profile, *, prompt: Callable[[Column], Column], mode: str = "adaptive", batch_size: int = 8, **calls
) -> tuple[DataFrame, DataFrame]:
    """inputs (recording_id, seq, id, start, stop, text) -> (refined segments with the ``unit`` that gave them, inputs that none did).

    ``prompt`` makes the request of a unit's list of inputs.  A unit whose answer
    breaks a rule goes to the next smaller units as a whole.
    """
    rows = sequence.batches(inputs, size=batch_size)
    units = {"recording": F.lit(0).cast("long"), "batch": F.col("batch"), "segment": F.col("seq").cast("long")}
    good, left = None, rows
    for unit in MODES[mode]:
        asked = left.withColumn("u", units[unit])
        name = F.concat_ws("/", F.col(KEY).cast("string"), F.col("u").cast("string"))
        asked = settle(asked.withColumn("unit_id", name))
        item = F.struct("seq", "id", "start", "stop", "text")
        requests = asked.groupBy("unit_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select("unit_id", prompt(F.col("items")).alias("prompt"))
        answered, _ = complete_json(requests, make_client, profile, SEGMENTS, **calls)
        # Rules look at a unit as if it were a recording.
        found = answered.select(F.col("unit_id").alias(KEY), F.posexplode("record.segments").alias("seq", "s")).select(KEY, "seq", "s.*")
        wanted = asked.select(F.col("unit_id").alias(KEY), "seq", "id", "start", "stop").join(answered.select(F.col("unit_id").alias(KEY)), KEY, "left_semi")
        broken = _violations(found, wanted).select(F.col(KEY).alias("unit_id")).distinct()
        fine = settle(answered.select("unit_id").join(broken, "unit_id", "left_anti"))
        own = asked.select("unit_id", KEY).distinct()
        kept = found.withColumnRenamed(KEY, "unit_id").join(fine, "unit_id", "left_semi").join(own, "unit_id").drop("unit_id", "seq").withColumn("unit", F.lit(unit))
        good = kept if good is None else good.unionByName(kept)
        left = asked.join(fine, "unit_id", "left_anti").drop("unit_id", "u")
    return good, left.drop("batch")
