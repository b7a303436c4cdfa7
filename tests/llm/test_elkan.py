"""Clusters by bounds against all distances in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from intervale.llm import elkan
from intervale.llm.elkan import Centres, Clustering, clusters, nearest, packed, scaled_floors, squared, unpacked
from intervale.llm.queries import op12_centroid_clusters

SF = "/root/testdata/sf0.001"


def plainly(rows, k=16, rounds=3, seed="1", size=64, scale=64):
    """(vec_id, vector) rows -> sorted result rows, all distances of all rounds."""

    def floor(x):
        n, d = float(x).as_integer_ratio()
        return scale * n // d

    kept = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda r: (text(r[0]), packed(np.array(r[1], object))))[:k]]

    def own(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        mine = [own(v)[1] for _, v in kept]
        for c in set(mine):
            of = [v for (_, v), m in zip(kept, mine, strict=True) if m == c]
            points[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    last = [own(v) for _, v in kept]
    fits = lambda n: n if n < 2**63 else None
    whole = sum(d for d, _ in last)
    out = []
    for (i, _), (d, c) in zip(kept, last, strict=True):
        out.append((i, c, fits(d), fits(sum(x for x, y in last if y == c)), fits(whole), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()))
    return sorted(out, key=str)


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_centroid_clusters(spark, SF).collect()), key=str) == plainly(rows)


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=v, cluster="other", vector=0, distance=1.5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, vector int, distance double").repartition(3)


def test_rows_of_any_kind(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in draw.integers(-3, 3, 4) / 64]) for i in range(80)]  # many ties
    rows += rows[:10] + [(5, [0.1, 0.2, 0.3, -0.4])]  # repeated rows, a repeated id
    rows += [(None, [1.0, 2.0, 3.0, 4.0])] * 2 + [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [math.nan] + [1.0] * 3), (105, [math.inf] + [1.0] * 3), (106, [0.0] * 4)]
    got = clusters(frame(spark, rows), k=7, rounds=3, seed="x", size=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plainly(rows, 7, 3, "x", 4)


def test_huge_components(spark):
    rows = [(i, [float(i % 5), -float(i % 7), 1e300 if i % 11 == 0 else 3e9 * (i % 3), 0.5]) for i in range(60)]
    got = clusters(frame(spark, rows), k=5, rounds=3, seed="1", size=4)
    assert sorted(map(tuple, got.collect()), key=str) == plainly(rows, 5, 3, "1", 4)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 4) for i in range(n)]
    assert sorted(map(tuple, clusters(frame(spark, rows), k=5, rounds=2, seed="1", size=4).collect()), key=str) == plainly(rows, 5, 2, "1", 4)


def test_bounds_save_distances(spark):
    """Well-parted clusters settle: later rounds work out a fraction of all distances."""
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 4, (10, 16))
    rows = [(i, [float(x) for x in centres[i % 10] + draw.normal(0, 0.1, 16)]) for i in range(2000)]
    model = Clustering(frame(spark, rows), 10, F.sha2(F.col("vec_id").cast("string"), 256), size=16).run(4)
    assert model.worked[-1] < 0.4 * 2000 * 10
    assert model.assigned().count() == 2000


def test_nearest_against_all_distances():
    """Bounds of any kind that hold never change an answer, ties included."""
    draw = np.random.default_rng(1)
    for _ in range(50):
        vectors = draw.integers(-2, 3, (40, 3))
        points = draw.integers(-2, 3, (6, 3)).tolist()
        exact = np.stack([squared(vectors, p) for p in points], axis=1)
        centres = Centres(points, np.zeros(6))
        own = draw.integers(0, 6, 40)
        upper = np.sqrt(exact[np.arange(40), own]) * draw.choice([1.0, 1.5, np.inf], 40)
        lower = np.sqrt(exact) * draw.choice([0.0, 0.5, 1.0], (40, 6))
        found, up, low, _ = nearest(vectors, centres, centres.halves(), own, elkan._up(upper), elkan._down(lower))
        assert (found == exact.argmin(axis=1)).all()
        assert (up >= np.sqrt(exact.min(axis=1))).all() and (low <= np.sqrt(exact)).all()


def test_packing():
    for row in ([0, 0], [127, -127], [128, 1], [-40000, 3], [1 << 20, -(1 << 20)], [1 << 21, 0], [1 << 80, -1]):
        assert unpacked([packed(np.array(row, dtype=object))], 2)[0].tolist() == row
    assert unpacked([packed(np.array(r, dtype=object)) for r in ([1, 2], [300, 4], [1 << 40, 0])], 2).tolist() == [[1, 2], [300, 4], [1 << 40, 0]]
    assert scaled_floors(np.array([[-0.01, 0.01, 1.999]]), 64).tolist() == [[-1, 0, 127]]
    assert scaled_floors(np.array([[1e300, -0.5]]), 64).tolist() == [[64 * int(1e300), -32]]
