"""Licence scan by canonical digest lookup.

A text is made canonical as a whole: copyright lines and list markers go, case
and punctuation too, and equivalent spellings become one.  The SHA-256 of what
is left is joined with the digests of known licences, made the same way.  Only
texts that are a licence from end to end match.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.licence_texts import KNOWN_TEXTS, full_texts
from intervale.llm.runtime import prepare

#: Known digests, of about 100 bytes each, are joined by broadcast up to so many.
MOST_KNOWN = 500_000

# Spellings that the SPDX matching guidelines hold to be equal, each to its first form.
SPELLINGS = """
acknowledgment acknowledgement
analog analogue
analyze analyse
artifact artefact
authorization authorisation
authorized authorised
caliber calibre
canceled cancelled
capitalizations capitalisations
catalog catalogue
categorize categorise
center centre
emphasized emphasised
favor favour
favorite favourite
fulfill fulfil
fulfillment fulfilment
initialize initialise
judgment judgement
labeling labelling
labor labour
license licence
maximize maximise
modeled modelled
modeling modelling
offense offence
optimize optimise
organization organisation
organize organise
practice practise
program programme
realize realise
recognize recognise
signaling signalling
utilization utilisation
while whilst
willful wilful
http https
"""
# The same for spellings of two words.
PHRASES = """
percent = per cent
noncommercial = non commercial
sublicense = sub license
copyright owner = copyright holder
"""

_same = {other: first for first, other in (line.split() for line in SPELLINGS.strip().splitlines())}
_phrases = [(f" {b} ", f" {a} ") for a, b in (line.split(" = ") for line in PHRASES.strip().splitlines())]
_word = re.compile(r"[^\W_]+")
_marker = re.compile(r"^[^\S\n]*(?:[0-9]{1,2}|[a-z])[.)][^\S\n]+", re.MULTILINE)
_copyright = re.compile(r"^[\W_]*(?:copyright\b(?=[^\n]*(?:\(c\)|©|\d{4}|<|\[|\bby\b))|\(c\)|©|all rights reserved)[^\n]*$", re.MULTILINE)
_hints = ("copyright", "(c)", "©", "all rights reserved")


def canonical(text: str | None) -> str:
    """The canonical form; empty for a text without a word."""
    low = (text or "").lower()
    if any(h in low for h in _hints):
        low = _copyright.sub("", low)
    words = _word.findall(_marker.sub("", low))
    joined = f" {' '.join([_same.get(w, w) for w in words])} "
    for old, new in _phrases:
        if old in joined:
            joined = joined.replace(old, new)
    return joined.strip()


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode("utf-8", "replace")).hexdigest()


def digest_column(text: Column) -> Column:
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([digest(t) for t in texts.to_pylist()], pa.string())

    compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compute, "string")(text)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(canonical_sha256, licence) of known texts; of equal canonical texts the first name, and none for texts without a word.

    ``known`` is (name, text) pairs, first come first, or a table (licence, text)
    of any size, of which the least name counts; else the texts of this package.
    """
    if isinstance(known, DataFrame):
        prepare(spark)
        none = digest("")
        rows = known.select("licence", digest_column(F.col("text")).alias("canonical_sha256")).where(F.col("licence").isNotNull() & (F.col("canonical_sha256") != none))
        return rows.groupBy("canonical_sha256").agg(F.min("licence").alias("licence"))
    names: dict[str, str] = {}
    for name, text in KNOWN_TEXTS + full_texts() if known is None else known:
        if canonical(text):
            names.setdefault(digest(text), name)
    return spark.createDataFrame(sorted(names.items()), "canonical_sha256 string, licence string")


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, canonical_sha256, licence (null where no known text is equal).

    See ``known_digests`` for what is known; a list of it is bounded by the
    driver's memory and joined by broadcast up to MOST_KNOWN digests.  Null
    counts as empty and is no licence; repeated rows keep a row each.
    """
    spark = prepare(docs.sparkSession)
    table = known_digests(spark, known)
    if not isinstance(known, DataFrame) and table.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        table = F.broadcast(table)
    found = docs.select(F.col(id_col).alias("doc_id"), digest_column(F.col(text_col)).alias("canonical_sha256"))
    return found.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "licence")
