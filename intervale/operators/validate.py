"""Rules as queries: each returns the rows (or recordings) that break it, with the rule's name.

``assert_valid`` raises on the first violation for callers that want an error.
Rules look at list order (``seq``); a recording is reported for what applies to
the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators.sequence import in_order
from intervale.schemas import MEANINGLESS_MEDIA, MEDIA

KEY = "recording_id"
REF_ID = r"\[\[REF:(\d+)\]\]"


class InvalidRows(ValueError):
    """Some rows break a rule."""


def assert_valid(violations: DataFrame) -> None:
    first = violations.limit(1).collect()
    if first:
        raise InvalidRows(str(first[0].asDict()))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""


def _report(rows: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """(recording_id, row_id, rule) for each rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(KEY, F.col(row_id).cast("long").alias("row_id"), F.explode(broken).alias("rule"))


def _positions(rows: DataFrame) -> DataFrame:
    order = in_order()
    return rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("pos"))


def marker_violations(markers: DataFrame, recordings: DataFrame) -> DataFrame:
    """Markers: at least one, ids dense from 0, start < stop, no overlap with the next, within [0, duration]."""
    bare = recordings.join(markers.select(KEY).distinct(), KEY, "left_anti").select(KEY, F.lit(None).cast("long").alias("row_id"), F.lit("empty").alias("rule"))
    rows = _positions(markers).select("*", F.lead("start").over(in_order()).alias("next_start"), F.lead("id").over(in_order()).alias("next_id")).join(recordings.select(KEY, "duration"), KEY)
    return _report(rows, "seq", {
        "id": F.col("id") != F.col("pos"),
        "interval": F.col("start") >= F.col("stop"),
        "overlap": F.col("stop") > F.col("next_start"),
        "before_zero": (F.col("pos") == 0) & (F.col("start") < 0),
        "past_end": F.col("next_id").isNull() & (F.col("stop") > F.col("duration")),
    }).unionByName(bare)


def block_violations(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """Blocks: ids dense from 0, start < stop, references before themselves, slots within their block."""
    own = _report(_positions(blocks), "seq", {
        "id": F.col("id") != F.col("pos"),
        "interval": F.col("start") >= F.col("stop"),
        "cross_ref": F.exists("cross_refs", lambda r: (r < 0) | (r >= F.col("id"))),
    })
    inside = slots.join(blocks.select(KEY, "seq", F.col("id").alias("block_id"), "start", "stop"), [KEY, "block_id"])
    bad = (F.col("slot_start") >= F.col("slot_stop")) | (F.col("slot_start") < F.col("start")) | (F.col("slot_stop") > F.col("stop"))
    return own.unionByName(_report(inside, "seq", {"slot": bad}).distinct())


def outline_violations(chapters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chapters over n blocks: cover 0..n-1 (first), ids dense from 1 with ordered ranges, no gap to the next.

    sizes (recording_id, n).  One rule a recording, the first broken in that order;
    a recording without chapters breaks ``empty``.
    """
    rows = _positions(chapters).select("*", F.lead("block_id_start").over(in_order()).alias("next_start"))
    found = rows.groupBy(KEY).agg(
        F.min_by("block_id_start", "pos").alias("first"), F.max_by("block_id_end", "pos").alias("last"),
        F.bool_or((F.col("id") != F.col("pos") + 1) | (F.col("block_id_start") > F.col("block_id_end"))).alias("bad_id"),
        F.bool_or(F.coalesce(F.col("block_id_end") + 1 != F.col("next_start"), F.lit(False))).alias("gap"),
    )
    joined = sizes.join(found, KEY, "left")
    rule = (
        F.when(F.col("first").isNull(), "empty").when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "coverage")
        .when(F.col("bad_id"), "id").when(F.col("gap"), "contiguity")
    )
    return joined.select(KEY, rule.alias("rule")).where("rule is not null")


def judgement_violations(judgements: DataFrame, frames: DataFrame) -> DataFrame:
    """Judgements against the frames they are of: (recording_id, frame_id, rule).

    Every frame is judged once and no other; media are known; a reason is given;
    a meaningful frame has a medium that can be, a key, a quality of 1 to 5 and a
    summary; any other has neither key nor quality.
    """
    copies = Window.partitionBy(KEY, "frame_id")
    known = frames.select(KEY, "frame_id").distinct().withColumn("known", F.lit(True))
    rows = judgements.withColumn("copies", F.count("*").over(copies)).join(known, [KEY, "frame_id"], "left")
    quality = F.col("quality_score")
    useful = F.col("medium").isin(*MEANINGLESS_MEDIA) | is_blank(F.col("semantic_key")) | quality.isNull() | ~quality.between(1, 5) | is_blank(F.col("content_summary"))
    broken = _report(rows, "frame_id", {
        "unknown_frame": F.col("known").isNull(),
        "duplicate": F.col("copies") > 1,
        "medium": ~F.coalesce(F.col("medium").isin(*MEDIA), F.lit(False)),
        "reason": is_blank(F.col("reason")),
        "meaningful": F.col("is_meaningful") & useful,
        "not_meaningful": ~F.col("is_meaningful") & (F.col("semantic_key").isNotNull() | quality.isNotNull()),
    }).distinct()
    missing = frames.select(KEY, "frame_id").distinct().join(judgements.select(KEY, "frame_id"), [KEY, "frame_id"], "left_anti")
    return broken.unionByName(missing.select(KEY, F.col("frame_id").cast("long").alias("row_id"), F.lit("missing").alias("rule")))


def reference_violations(rows: DataFrame) -> DataFrame:
    """rows (recording_id, seq, id, text, cross_refs): references in 0..id-1, equal as a set to the marks in the text."""
    marks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(REF_ID), 1), lambda x: x.cast("long"))))
    refs = F.array_sort(F.array_distinct(F.transform("cross_refs", lambda x: x.cast("long"))))
    return _report(rows, "seq", {
        "range": F.exists("cross_refs", lambda r: (r < 0) | (r >= F.col("id"))),
        "marks": marks != refs,
    })


def refined_violations(refined: DataFrame, markers: DataFrame, *, drift: float) -> DataFrame:
    """Refined segments against their markers by position: equal id, bounds within the drift, nothing blank.

    Where refined has them, ``topic`` and ``summary`` may not be blank and
    ``language`` is that of the markers; references follow ``reference_violations``.
    """
    r = _positions(refined)
    of_markers = [F.col("language").alias("m_language")] if "language" in markers.columns else []
    m = _positions(markers).select(KEY, "pos", F.col("id").alias("m_id"), F.col("start").alias("m_start"), F.col("stop").alias("m_stop"), *of_markers)
    blank = is_blank(F.col("text"))
    for c in ("topic", "summary"):
        blank = blank | is_blank(F.col(c)) if c in refined.columns else blank
    languages = {"language": F.col("language") != F.col("m_language")} if of_markers and "language" in refined.columns else {}
    rows = r.join(m, [KEY, "pos"], "full_outer").withColumn("seq", F.coalesce("seq", "pos"))
    return _report(rows, "seq", {
        "count": F.col("m_id").isNull() | F.col("id").isNull(),
        "id": F.col("id") != F.col("m_id"),
        "drift": (F.abs(F.col("start") - F.col("m_start")) > drift) | (F.abs(F.col("stop") - F.col("m_stop")) > drift),
        "blank": F.col("id").isNotNull() & blank, **languages,
    })


def speech_violations(segments: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Transcribed segments: start < stop, start not before the end of the last earlier one with text, words not reversed.

    Of the recordings given, those without any segment break the rule ``empty``, in no row.
    """
    last = F.last(F.when(~is_blank(F.col("text")), F.col("stop")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    broken = _report(segments.withColumn("previous_stop", last), "seq", {
        "interval": F.col("start") >= F.col("stop"),
        "order": F.col("start") < F.col("previous_stop"),
        "word": F.exists("words", lambda w: w["start"] > w["stop"]) if "words" in segments.columns else F.lit(False),
    })
    if recordings is None:
        return broken
    empty = recordings.select(KEY).distinct().join(segments.select(KEY), KEY, "left_anti")
    return broken.unionByName(empty.select(KEY, F.lit(None).cast(broken.schema["row_id"].dataType).alias("row_id"), F.lit("empty").alias("rule")))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], what: str, *, last_by: str | None = None) -> DataFrame:
    """rows plus the values of the row of ``table`` with the same keys; a row without one is an error when it is read.

    So is one that ``table`` has several rows for, unless ``last_by`` names what
    orders them: then the last one counts.
    """
    of_key = [(F.first(v) if last_by is None else F.max_by(v, last_by)).alias(v) for v in values]
    held = table.groupBy(*keys).agg(F.count("*").alias("_held"), *of_key)
    joined = rows.join(held, keys, "left")
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    wrong = F.raise_error(F.concat(F.when(F.col("_held").isNull(), "no").otherwise("more than one"), F.lit(f" {what} for "), named))
    found = F.col("_held") >= 1 if last_by is not None else F.col("_held") == 1
    # The check guards the values, so that no plan can leave it out.
    checked = [F.when(found, F.col(v)).otherwise(wrong.cast(joined.schema[v].dataType)).alias(v) for v in values]
    return joined.select(*rows.columns, *checked)


def missing_sections(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Chapters without a section."""
    return chapters.select(KEY, "chapter_id").join(sections.select(KEY, "chapter_id"), [KEY, "chapter_id"], "left_anti")
