"""Model stages as DataFrame passes: ask, check the answer, ask again with what was wrong.

Every pass ends in a table of the shared folder, so that no model is asked twice
for one row however often later passes read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.functions.text import description_verdict, fenced_json, strip
from intervale.operators import validate
from intervale.operators.admission import token_estimate
from intervale.plans import envelopes
from intervale.plans.clients import Client, complete_rows
from intervale.plans.config import Options, Profile
from intervale.schemas import TEXT_MEDIA
from intervale.settling import settle
from intervale.sources.files import strict_json

KEY = "recording_id"
REPAIR = "The answer below is not the JSON that was asked for. Answer again, with that JSON and nothing else."
OUTLINE_AGAIN = "Write the outline again, as JSON and nothing else."
OUTLINE = "chapters array<struct<id: bigint, title: string, summary: string, block_id_start: bigint, block_id_end: bigint>>"
JUDGEMENTS = (
    "judgements array<struct<frame_id: bigint, medium: string, is_meaningful: boolean, reason: string, semantic_key: string, quality_score: bigint, visible_text: string, content_summary: string>>"
)
DESCRIPTION = "visible_text string, visible_evidence array<string>, description string"


def complete_text(rows: DataFrame, make_client: Callable[[], Client], profile: Profile, options: Options = Options(), *, prompt: str = "prompt", parts: str | None = None, images: Column | None = None, **calls) -> DataFrame:
    """rows plus ``answer``, or ``error_class`` and ``message``; a column of ``parts`` is sent in place of the prompt, and goes.

    A request over the profile's context is a ContextLength error, one that asks
    for what the model can't do a Model error; neither is sent.
    """
    asked = profile.options(options)
    count = envelopes.pictures(F.col(parts)) if parts else F.lit(0) if images is None else images
    length = envelopes.text_length(F.col(parts)) if parts else F.length(prompt)
    size = token_estimate(length + len("user"), count) + (options.max_output_tokens or 0)
    plain, seeing = (profile.refuses(asked, images=x) for x in (False, True))
    refused = F.when(F.lit(plain).isNotNull(), F.concat(F.lit("Model: "), F.lit(plain))).when((count > 0) & F.lit(seeing).isNotNull(), F.concat(F.lit("Model: "), F.lit(seeing)))
    if profile.max_context is not None:
        over = F.concat(F.lit("ContextLength: "), size.cast("string"), F.lit(f" > {profile.max_context}"))
        refused = F.when(size > profile.max_context, over).otherwise(refused)
    ready = rows.withColumns({"_refused": refused.cast("string"), "_tokens": size})
    return complete_rows(ready, make_client, prompt=prompt, parts=parts, refused="_refused", tokens="_tokens", **calls).drop("_tokens")


def attempts(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame], *, times: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, failed attempts) of up to so many passes, each with its number as ``attempt``.

    ``ask`` gives rows with a ``reason``, null for an answer that will do, and
    ``error_class``, set for a request that failed and isn't asked again;
    ``again`` turns refused rows into rows to ask once more.
    """
    good, bad, left = None, None, rows
    for n in range(1, times + 1):
        asked = settle(ask(left).withColumn("attempt", F.lit(n)))
        fine, refused = asked.where("reason is null and error_class is null"), asked.where("reason is not null or error_class is not null")
        good, bad = (fine if good is None else good.unionByName(fine)), (refused if bad is None else bad.unionByName(refused))
        left = again(refused.where("error_class is null")).select(*rows.columns)
    return good, bad


def complete_json(
    rows: DataFrame, make_client: Callable[[], Client], profile: Profile, schema: str, *, repairs: int = 1, prompt: str = "prompt", parts: str | None = None, options: Options = Options(), **calls
) -> tuple[DataFrame, DataFrame]:
    """(rows plus ``record`` and ``answer``, failed attempts): answers decoded strictly, whole or from their first fence.

    The schema is in DDL.  What doesn't decode is sent back with the reason and
    the answer, which replace the prompt, as often as ``repairs`` says.  With
    ``parts``, rows have them beside an unsent prompt; a repair is a text alone.
    """
    options = Options(**(options.__dict__ | {"json_mode": "json_mode" in profile.capabilities}))

    def ask(left: DataFrame) -> DataFrame:
        answered = complete_text(left, make_client, profile, options, prompt=prompt, parts=parts, **calls).withColumn("_json", F.coalesce(fenced_json(F.col("answer")), F.lit("")))
        return strict_json(answered, "_json", T.StructType.fromDDL(schema)).withColumn("reason", F.when(F.col("error_class").isNull(), F.col("error"))).drop("_json", "error")

    def again(bad: DataFrame) -> DataFrame:
        once_more = bad.withColumn(prompt, F.concat(F.lit(f"{REPAIR}\n\nWhat is wrong: "), "reason", F.lit("\n\nRejected answer:\n"), "answer"))
        return once_more.withColumn(parts, F.array(envelopes.text_part(F.col(prompt)))) if parts else once_more

    return attempts(rows, ask, again, times=repairs + 1)


def _inner(rows: DataFrame, key: str, make_client, profile, schema, **calls) -> DataFrame:
    """rows plus record, answer and error_class: a JSON completion with its own repair, as one row each."""
    good, bad = complete_json(rows, make_client, profile, schema, **calls)
    last = bad.join(good.select(key), key, "left_anti").groupBy(key).agg(F.max_by(F.struct(F.coalesce("error_class", F.lit("Model")).alias("error_class"), F.coalesce("message", "reason").alias("message"), "answer"), "attempt").alias("_e"))
    found = good.select(key, "record", "answer").unionByName(last.select(key, "_e.answer"), allowMissingColumns=True)
    kept = rows.drop(calls["parts"]) if calls.get("parts") else rows
    return kept.join(found, key, "left").join(last.select(key, "_e.error_class", "_e.message"), key, "left")


def outlines(rows: DataFrame, make_client: Callable[[], Client], profile: Profile, *, times: int = 2, **calls) -> tuple[DataFrame, DataFrame]:
    """rows (recording_id, prompt, n_blocks) -> (accepted (recording_id, chapters, attempt), failures).

    An outline has to cover all blocks; else it is asked for again with the rule
    it broke, the blocks it has to cover, the prompt and the last answer.  Failures
    hold what a debug record needs.
    """
    base = rows.select(KEY, "prompt", "n_blocks").withColumn("first_prompt", F.col("prompt"))

    def ask(left: DataFrame) -> DataFrame:
        done = settle(_inner(left, KEY, make_client, profile, OUTLINE, **calls))
        chapters = done.where("record is not null").select(KEY, F.posexplode("record.chapters").alias("seq", "c")).select(KEY, "seq", "c.id", "c.block_id_start", "c.block_id_end")
        rules = validate.outline_violations(chapters, done.where("record is not null").select(KEY, F.col("n_blocks").alias("n")))
        return done.join(rules.withColumnRenamed("rule", "reason"), KEY, "left")

    def again(bad: DataFrame) -> DataFrame:
        text = F.concat(
            F.lit(f"{OUTLINE_AGAIN} It broke the rule: "), "reason", F.lit(". It has to take in the blocks 0 to "), (F.col("n_blocks") - 1).cast("string"),
            F.lit(", each of them once, in chapters numbered from 1.\n\nFirst request:\n"), "first_prompt", F.lit("\n\nRejected answer:\n"), "answer",
        )
        return bad.withColumn("prompt", text)

    good, bad = attempts(base, ask, again, times=times)
    failures = bad.select(KEY, F.lit("outline").alias("stage_name"), "attempt", F.coalesce("error_class", F.lit("Model")).alias("error_class"), F.coalesce("message", "reason").alias("message"), "prompt", "answer", "n_blocks")
    return good.select(KEY, F.col("record.chapters").alias("chapters"), "attempt"), failures


def judgements(
    frames: DataFrame, make_client: Callable[[], Client], profile: Profile, *, prompt: Callable[[Column], Column] | Column, label: Column | None = None, most_tokens: int | None = None, block: float = 600.0, **calls
) -> tuple[DataFrame, DataFrame]:
    """frames (recording_id, frame_id, ts, ..) -> (judgements of recordings that break no rule, (recording_id, rule) of the others).

    One request a recording, with all of its frames in time order, which
    ``prompt`` makes; an answer has to judge every frame once.  With a ``label``,
    frames have ``mime`` and ``content`` too, the prompt is a column, and a request is that,
    then each frame's label and picture; a recording over ``most_tokens`` is then
    several requests (``envelopes.picture_envelopes``), whose judgements have to cover its frames together.
    """
    if label is None:
        item = F.struct("ts", "frame_id", *[c for c in frames.columns if c not in (KEY, "ts", "frame_id")])
        rows = frames.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("f"))
        rows, key = rows.select(KEY, prompt(F.col("f")).alias("prompt")), KEY
    else:
        made = envelopes.picture_envelopes(frames, prompt=prompt, label=label, most_tokens=most_tokens, block=block)
        rows, key = made.select(F.concat_ws("#", F.col("request").cast("string"), F.col(KEY).cast("string")).alias("_request"), KEY, F.col("parts")[0]["text"].alias("prompt"), "parts"), "_request"
        calls["parts"] = "parts"
    answered = settle(_inner(rows, key, make_client, profile, JUDGEMENTS, **calls))
    whole = answered.groupBy(KEY).agg(F.count_if(F.col("record").isNull()).alias("n")).where("n = 0").select(KEY)
    found = answered.where("record is not null").select(KEY, F.explode("record.judgements").alias("j")).select(KEY, "j.*").join(whole, KEY, "left_semi")
    broken = settle(validate.judgement_violations(found, frames.drop("mime", "content").join(whole, KEY, "left_semi")).select(KEY, "rule").distinct())
    failed = answered.where("record is null").select(KEY, F.coalesce("error_class", F.lit("Model")).alias("rule")).distinct()
    return found.join(broken, KEY, "left_anti"), broken.unionByName(failed)


def descriptions(rows: DataFrame, make_client: Callable[[], Client], profile: Profile, *, key: str = "frame_id", times: int = 3, **calls) -> tuple[DataFrame, DataFrame]:
    """rows (key, medium, prompt) -> (accepted (key, description, visible_text, visible_evidence, attempt), failures).

    A description that breaks a rule is asked for again, up to so many times, with
    that rule named after the first prompt.  Rows with ``mime`` and ``content`` send
    their picture after the prompt, at each attempt.
    """
    base = rows.select(key, "medium", "prompt").withColumn("first_prompt", F.col("prompt"))

    seen = rows.select(key, "mime", "content") if "content" in rows.columns else None

    def ask(left: DataFrame) -> DataFrame:
        if seen is None:
            done = _inner(left, key, make_client, profile, DESCRIPTION, **calls)
        else:
            pictured = left.join(seen, key, "left").withColumn("parts", envelopes.beside(F.col("prompt"), F.col("mime"), F.col("content"))).drop("mime", "content")
            done = _inner(pictured, key, make_client, profile, DESCRIPTION, parts="parts", **calls)
        r = F.col("record")
        verdict = description_verdict(r["description"], r["visible_text"], r["visible_evidence"], F.col("medium"), TEXT_MEDIA)
        return done.withColumn("reason", F.when(F.col("error_class").isNull(), verdict))

    def again(bad: DataFrame) -> DataFrame:
        return bad.withColumn("prompt", F.concat("first_prompt", F.lit("\n\nThe last answer was refused: "), "reason", F.lit(". Answer again, as JSON with a description, visible_text and visible_evidence.")))

    good, bad = attempts(base, ask, again, times=times)
    kept = F.filter(F.transform("record.visible_evidence", strip), lambda x: x != "")
    failures = bad.select(key, F.lit("describe").alias("stage_name"), "attempt", F.coalesce("error_class", F.lit("Model")).alias("error_class"), F.coalesce("message", "reason").alias("message"), "prompt", "answer")
    return good.select(key, "record.description", "record.visible_text", kept.alias("visible_evidence"), "attempt"), failures
