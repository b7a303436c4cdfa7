"""Text functions as column expressions; pandas functions only where Spark has no equivalent (Unicode forms)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that a slug replaces, marks in a text, shown times, punctuation that hugs what is before it,
# what counts as content, words for what can't be read, and talk of audio.
UNSAFE = r"(?U)[\s\[\]()`*_{}<>#!|\\/?:;,.]+"
TS_MARK = r"\[\[TS:(\d+(?:\.\d+)?)(?:-\d+(?:\.\d+)?)?\]\]"
LONE_TS_MARK = r"^\[\[TS:(\d+(?:\.\d+)?)\]\]$"
REF_MARK = r"\[\[REF:(\d+)\]\]"
SHOWN_TIME = r"(?:\[\d{2}:\d{2}:\d{2}\]\([^\)\n]+\)|\[\d{2}:\d{2}:\d{2}\](?!\())"
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"
PUNCTUATION = "。！？；，、,.!?;:"
CONTENT = r"(?U)[\w\x{4e00}-\x{9fff}]"
UNREADABLE = r"(?i)(不可读|无法读取|无法辨认|看不清|unreadable|illegible)"
AUDIO_TALK = r"(?i)(音频中|结合音频|相呼应|配合音频|标志着本节收尾|audio context)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def round3(value: Column) -> Column:
    """Half-even rounding of the exact binary value to three places.

    A thousand times the value is a double and an exact rest (the value is split
    into halves whose products are exact), so a tie is known for what it is.
    """

    def one(x: Column) -> Column:
        y, wide = x * 1000.0, x * 134217729.0
        high = wide - (wide - x)
        rest = (high * 1000.0 - y) + (x - high) * 1000.0
        low = F.floor(y).cast("double")
        over = (y - low) - 0.5
        up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))))
        return F.when(F.abs(x) < float(1 << 42), (low + F.when(up, 1.0).otherwise(0.0)) / 1000.0).otherwise(x)

    return bind(value.cast("double"), one)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def hms(seconds: Column) -> Column:
    """hh:mm:ss of the whole seconds; hours grow without bound."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def mmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def _fill(template: str, fields: dict[str, Column]) -> Column:
    out = F.lit(template)
    for field, value in fields.items():
        out = F.replace(out, F.lit("{" + field + "}"), value)
    return out


def _time_fields(s: Column) -> dict[str, Column]:
    return {"hms": hms(s), "mmss": mmss(s), "seconds": F.format_string("%.3f", round3(s)), "seconds_int": F.floor(s).cast("string")}


def render_time(seconds: Column, template: str) -> Column:
    """{hms}, {mmss}, {seconds} and {seconds_int} of the seconds rounded to milliseconds."""
    return bind(round3(seconds), lambda s: _fill(template, _time_fields(s)))


def parse_time_mark(text: Column) -> Column:
    """Seconds, to milliseconds, of a text that is one time mark and nothing else; raises otherwise, as for a range."""
    return F.when(text.rlike(LONE_TS_MARK), round3(F.regexp_extract(text, LONE_TS_MARK, 1).cast("double"))).otherwise(F.raise_error(F.concat(F.lit("not a time mark: "), text)))


def render_time_marks(text: Column, template: str = "[{hms}]", url: str | None = None, source_path: Column | None = None) -> Column:
    """Each [[TS:a]] or [[TS:a-b]] as the template of a, linked by a URL template of the same fields if given.

    The shown time is of a rounded to milliseconds, the link's fields of a itself;
    a link can also have {source_path} and {source_filename}.  Splits at the
    marks and puts pieces and rendered marks back in order.
    """
    fields_of_path = {}
    if url is not None:
        path = F.lit("") if source_path is None else source_path
        fields_of_path = {"source_path": path, "source_filename": F.element_at(F.split(path, "/"), -1)}

    def shown(mark: Column) -> Column:
        label = render_time(mark, template)
        return label if url is None else F.concat(F.lit("["), label, F.lit("]("), _fill(url, _time_fields(mark) | fields_of_path), F.lit(")"))

    return _at_marks(text, TS_MARK, lambda found: bind(found.cast("double"), shown))


def _at_marks(text: Column, mark: str, shown: Callable[[Column], Column]) -> Column:
    """The text with ``shown(what a mark's group holds)`` in place of each mark; text and marks are worked out once."""

    def whole(t: Column) -> Column:
        # The piece after the last mark meets a null.
        return F.array_join(F.zip_with(F.split(t, mark, -1), F.regexp_extract_all(t, F.lit(mark), 1), lambda piece, found: F.when(found.isNull(), piece).otherwise(F.concat(piece, shown(found)))), "")

    return bind(text, whole)


def render_ref_marks(text: Column, anchors: Column) -> Column:
    """Each [[REF:n]] as ``[§n+1](#anchor)``, or ``§n+1`` where the map of anchors has no n."""

    def shown(found: Column) -> Column:
        def link(n: Column) -> Column:
            label = F.concat(F.lit("§"), (n + 1).cast("string"))
            return bind(F.try_element_at(anchors, n), lambda anchor: F.when(anchor.isNull(), label).otherwise(F.concat(F.lit("["), label, F.lit("](#"), anchor, F.lit(")"))))

        return bind(found.cast("long"), link)

    return _at_marks(text, REF_MARK, shown)


def strip_ref_marks(text: Column) -> Column:
    return F.regexp_replace(text, REF_MARK, "")


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, UNSAFE, "-"), "-+", "-"), "^-|-$", "")


def chapter_anchor(chapter_id: Column, title: Column, *, unicode_form: bool = True) -> Column:
    """chapter-<id>-<slug of the lower-cased title>, without the slug where nothing is left of it."""
    slug = _slug(F.lower(strip(nfkc(title) if unicode_form else title)))
    return F.concat(F.lit("chapter-"), chapter_id.cast("string"), F.when(slug == "", "").otherwise(F.concat(F.lit("-"), slug)))


def output_stem(name: Column, *, unicode_form: bool = True) -> Column:
    """A file name's stem as a slug in its own case; ``note`` where nothing is left."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    slug = _slug(strip(nfkc(stem) if unicode_form else stem))
    return F.when(slug == "", "note").otherwise(slug)


def strip_heading(text: Column, title: Column) -> Column:
    """Without a first line that is the title as a heading.

    # and ## match the title or anything that ends with a space and the title;
    ### and #### match the title alone.  Leading blank lines go in any case.
    """

    def without(body: Column, first: Column) -> Column:
        def by(high: Column) -> Column:
            is_high = first.rlike(r"(?U)^#{1,2}\s+") & ((high == title) | high.endswith(F.concat(F.lit(" "), title)))
            is_low = first.rlike(r"(?U)^#{3,4}\s+") & (strip(F.regexp_extract(first, r"(?U)^#{3,4}\s+(.*)$", 1)) == title)
            return F.when(is_high | is_low, F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"(?U)^\s+", "")).otherwise(body)

        # Most first lines are no headings, and are told from one by a character.
        return F.when(first.startswith("#"), bind(strip(F.regexp_extract(first, r"(?U)^#{1,2}\s+(.*)$", 1)), by)).otherwise(body)

    bare = bind(F.regexp_replace(text, r"(?U)^(?:[^\S\n]*\n)+", ""), lambda body: F.when(strip(body) == "", "").otherwise(body))
    return bind(bare, lambda body: bind(strip(F.split_part(body, F.lit("\n"), F.lit(1))), lambda first: without(body, first)))


def normalise_spacing(text: Column) -> Column:
    """Line by line: no blanks at the end; a lone time goes to the front, punctuation before times, and a space after them.

    Heading lines stay as they are but for their end.  Any of Unicode's line ends
    parts lines, and becomes a line feed; one at the very end goes.
    """

    def alone(line: Column, times: Column) -> Column:
        """A line's one time, if it has just one, in front."""
        time = F.get(times, F.lit(0))
        first = F.concat_ws(" ", time, F.nullif(strip(F.regexp_replace(line, SHOWN_TIME, "")), F.lit("")))
        return F.when((F.size(times) == 1) & ~line.startswith(time), first).otherwise(line)

    def spaced(line: Column) -> Column:
        timed = F.regexp_replace(line, rf"(?U)({SHOWN_TIME})\s*([{PUNCTUATION}])", "$2$1")
        return F.regexp_replace(F.regexp_replace(timed, rf" +([{PUNCTUATION}])", "$1"), rf"(?U)({SHOWN_TIME})(?!\s|$)", "$1 ")

    def one(line: Column) -> Column:
        body = bind(F.regexp_extract_all(line, F.lit(f"({SHOWN_TIME})"), 1), lambda times: spaced(alone(line, times)))
        return F.when(line.rlike(r"(?U)^\s*#"), line).otherwise(body)

    lines = F.split(F.regexp_replace(text, f"{LINE_END}\\z", ""), LINE_END, -1)
    return F.array_join(F.transform(lines, lambda line: bind(F.regexp_replace(line, r"(?U)\s+$", ""), one)), "\n")


def rewrite_links(text: Column, links: Column) -> Column:
    """Link targets ``](old)`` by a map of old to new, longest old first."""
    entries = F.array_sort(F.map_entries(links), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    swap = lambda t, e: F.replace(t, F.concat(F.lit("]("), e["key"], F.lit(")")), F.concat(F.lit("]("), e["value"], F.lit(")")))
    return F.aggregate(entries, text, swap)


def description_verdict(description: Column, visible_text: Column, evidence: Column, medium: Column, text_media: tuple[str, ...]) -> Column:
    """Why a description is refused, or null: no content, talk of audio, no evidence, or no text where the medium needs it.

    Null counts as empty.
    """
    description, visible_text = F.coalesce(description, F.lit("")), F.coalesce(visible_text, F.lit(""))
    kept = F.filter(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), strip), lambda x: x != "")
    legible = visible_text.rlike(CONTENT) | visible_text.rlike(UNREADABLE)
    return (
        F.when(~description.rlike(CONTENT), "content").when(description.rlike(AUDIO_TALK), "audio")
        .when(F.size(kept) == 0, "evidence").when(medium.isin(*text_media) & ~legible, "visible_text")
    )


def fenced_json(text: Column) -> Column:
    """The JSON in a text: the whole of it, or what its first fence holds; null where neither parses."""
    inner = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    whole, fenced = F.try_parse_json(text), F.try_parse_json(inner)
    return F.coalesce(F.to_json(whole), F.to_json(fenced))


def trim_label(minutes: Column) -> Column:
    """``10`` or ``2.5``: up to six places without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", minutes), r"\.?0+$", "")


def stamped(path: Column, stamp: Column | str) -> Column:
    """A note's path with ``-stamp`` before its extension."""
    stamp = F.lit(stamp) if isinstance(stamp, str) else stamp
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("-"), stamp, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def assets_folder(path: Column) -> Column:
    """The folder of a note's images, beside it."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_assets"))


def asset_path(note: Column, image: Column) -> Column:
    """Where a note keeps an image; raises for an image path that is absolute or climbs."""
    name = F.concat(assets_folder(note), F.lit("/"), F.element_at(F.split(image, "/"), -1))
    return F.when(is_contained(image), name).otherwise(F.raise_error(F.concat(F.lit("image path must stay below its folder: "), image)))


def markdown_image(note: Column, image: Column) -> Column:
    """The same as a link from the note."""
    return F.array_join(F.slice(F.split(asset_path(note, image), "/"), -2, 2), "/")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def relative_path(target: Column, folder: Column) -> Column:
    """A path as seen from a folder of the same tree."""
    a, b = F.split(target, "/"), F.filter(F.split(folder, "/"), lambda x: x != "")
    a = F.filter(a, lambda x: x != "")
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b)) + 1), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)) | (i > F.size(b)))
    k = F.element_at(differ, 1) - 1  # parts that both begin with
    return F.concat(F.repeat(F.lit("../"), F.size(b) - k), F.array_join(F.slice(a, k + 1, F.size(a)), "/"))


def file_stamp(at: Column, zone: str) -> Column:
    """``yyyyMMdd-HHmmss`` of a UTC time in a zone; for file names."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyyMMdd-HHmmss")


def iso_stamp(at: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffff+00:00`` of a UTC time; for front matter."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def render_prompt(template: str, fields: dict[str, Column]) -> Column:
    """``{{ name }}`` of a template as the columns of that name, comments ``{# #}`` left out; an unknown name is an error."""
    bare = re.sub(r"\{#.*?#\}", "", template, flags=re.DOTALL)
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", bare)
    unknown = set(pieces[1::2]) - set(fields)
    if unknown:
        raise ValueError(f"no column for {sorted(unknown)}")
    return F.concat(*[F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def unknown_fields(template: Column, allowed: tuple[str, ...]) -> Column:
    """Names in braces of a template that it can't have, ascending."""
    plain = F.regexp_replace(template, r"\{\{|\}\}", "")
    found = F.regexp_extract_all(plain, F.lit(r"\{([^{}:!]+)[^{}]*\}"), 1)
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, allowed))))


def is_contained(path: Column) -> Column:
    """A relative path that doesn't climb out of its folder."""
    return ~(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def is_local_endpoint(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin("localhost", "127.0.0.1", "::1", "[::1]"), F.lit(False))


def fraction(text: Column) -> Column:
    """``a/b`` or a number as a double; 0 where b is 0."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(text.contains("/"), F.when(bottom == 0, 0.0).otherwise(top / bottom)).otherwise(text.try_cast("double"))
