"""Importance resampling against plain counts of strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from intervale.llm import importance
from intervale.llm.importance import Checksums, FeatureCounts, joined_crc, resampled, split_words
from intervale.llm.queries import op11_importance_resampling

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text):
    w = words(text)
    return Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plainly(docs, target, buckets=10_000, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets

    def sums(texts):
        out = [0] * buckets
        for t in texts:
            for f, n in features(t).items():
                out[bucket(f)] += n
        return out

    s, t = sums(x for _, x in docs), sums(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        found = features(x)
        weight = sum(n * gain[bucket(f)] for f, n in found.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op11_importance_resampling(spark, SF).collect()), key=str) == plainly(docs, target)


def frame(spark, rows, id_col):
    made = [Row(**{id_col: i, "text": t, "chunk": "x", "score": 1, "rank": "r", "part": 2.0, "id": 3}) for i, t in rows]
    return spark.createDataFrame(made, f"{id_col} long, text string, chunk string, score int, rank string, part double, id int").repartition(3)


@pytest.mark.parametrize("chunk", [7, 40, 1 << 20])
def test_rows_of_any_kind(spark, monkeypatch, chunk):
    """Nulls, empty and long texts, repeats, ties; as many chunks and ranges as there may be."""
    monkeypatch.setattr(importance, "LEAST_WORDS", chunk)
    monkeypatch.setattr(importance, "MOST_WORDS", chunk)
    docs = [(1, None), (2, ""), (3, " .,-- "), (4, "One"), (5, "one, TWO"), (None, "a b c d"), (None, "a b c d"), (6, "ÄÖ été 東京 x\x00y\x1cz"), (7, "a " * 3000), (8, "A a"), (8, "A a")]
    docs += [(100 + i, f"the common line of all documents number {i % 3}") for i in range(30)] + [(200, "w" * 5000 + " " + "w" * 5000 + " v")]
    target = [(1, "the common line"), (2, None), (3, "東京 x")]
    got = resampled(frame(spark, docs, "doc_id"), frame(spark, target, "item_id"), buckets=97, least_words=2, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, [t for _, t in target], 97, 2, 50)


def test_empty_tables(spark):
    none, some = frame(spark, [], "doc_id"), frame(spark, [(1, "a b"), (2, None)], "doc_id")
    assert resampled(none, frame(spark, [], "item_id"), buckets=5).collect() == []
    assert sorted(map(tuple, resampled(some, frame(spark, [], "item_id"), buckets=5, least_words=0, percent=100).collect()), key=str) == plainly([(1, "a b"), (2, None)], [], 5, 0, 100)
    assert FeatureCounts(some.limit(0), buckets=5, id_col="doc_id").totals == [0] * 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), min_size=1, max_size=8))
def test_joined_checksums(pairs):
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    lengths = np.array([len(b) for _, b in pairs])
    assert joined_crc(crc(0), crc(1), lengths).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_checksums_of_words():
    sums = Checksums(pa.array([b"a", b"word", "é".encode()]))
    pair = sums.extended(sums.alone[[0, 1]], np.array([1, 2]))
    assert pair.tolist() == [zlib.crc32(b"a word"), zlib.crc32("word é".encode())]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZ09 _@[`{\x7f\x00é東 \n", max_size=12), max_size=6), st.integers(0, 2))
def test_split_words(texts, skip):
    whole = pa.array([t.encode() for t in ["xx"] * skip + texts], pa.binary()).slice(skip)
    found, place, counts = split_words(whole)
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert [found[int(p)].as_py().decode() for p in place] == [w for t in texts for w in words(t)]
