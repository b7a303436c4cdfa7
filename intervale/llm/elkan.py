"""Clusters around centroids, with Elkan's bounds, in whole numbers.

Vectors are whole numbers (floors of scaled components), and so are centroids
(floors of means).  Each vector keeps an upper bound of the distance to its own
centroid and a lower bound of that to each centroid; both move by as much as the
centroids do.  A distance is worked out only where the bounds and the distances
between centroids leave the question open: bounds are doubles rounded outwards
and only strictly larger ones rule a centroid out, so ties are always decided
on the exact squared distances, for the smaller number.

A round is one pass over a table of vectors with their bounds, which each task
reads and writes in its place, without a shuffle.  The last row that a task
writes is the sum of its vectors for each cluster, so that the new centroids
need that one column only.  What comes to the driver is bounded by the numbers of
clusters and components.  Tables are in the shared folder: a lost task is done
again from the table of the round before.

Components are kept in as few bytes as a vector's largest one needs.  Those that
64-bit distances could not hold are worked out in Python's whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.llm.runtime import Scratch, give_back, prepare

#: Components up to here have squared distances of up to 2**20 components within 64 bits.
LARGEST = 1 << 20
#: Bits of a digit of the sums that tasks write; digits of all tasks add up in decimals.
DIGIT = 48
ROWS = 4000
LONGEST = (1 << 63) - 1


# ---------------------------------------------------------------- whole numbers


def scaled_floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for finite doubles x: int64 if all are within LARGEST, else Python's numbers."""
    with np.errstate(over="ignore"):
        found = np.floor(values * scale)
    if not np.abs(found).max(initial=0) > LARGEST:
        return found.astype(np.int64)
    exact = [int(v) if abs(v) <= LARGEST else (int(x) * scale if abs(x) >= 2.0**52 else int(v)) for v, x in zip(found.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(values.shape)


def packed(row: np.ndarray) -> bytes:
    """A vector in 1, 2 or 4 bytes a component behind a byte that says so, or as text behind a zero."""
    most = max(abs(int(row.max(initial=0))), abs(int(row.min(initial=0))))
    for width in (1, 2, 4):
        if most < 1 << (8 * width - 1) and most <= LARGEST:
            return bytes([width]) + row.astype(f"<i{width}").tobytes()
    return b"\0" + ",".join(map(str, row.tolist())).encode()


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """[rows, size], int64 if none is larger than LARGEST."""
    widths = {row[0] for row in rows}
    if widths <= {1} or widths <= {2} or widths <= {4}:
        width = next(iter(widths), 1)
        return np.frombuffer(b"".join(row[1:] for row in rows), f"<i{width}").reshape(len(rows), size).astype(np.int64)
    out = np.empty((len(rows), size), dtype=object if 0 in widths else np.int64)
    for i, row in enumerate(rows):
        out[i] = [int(x) for x in row[1:].split(b",")] if row[0] == 0 else np.frombuffer(row[1:], f"<i{row[0]}").tolist()
    return out


def squared(vectors: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of each vector to a centroid."""
    if vectors.dtype != object and max(map(abs, centroid), default=0) <= LARGEST:
        off = vectors - np.array(centroid, np.int64)
        return np.einsum("ij,ij->i", off, off)
    off = vectors.astype(object) - np.array(centroid, dtype=object)
    return (off * off).sum(axis=1) if len(off) else np.zeros(0, object)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """A double no smaller (or no larger) than the root of each whole number; those too large for a double give infinity (or the largest double)."""
    try:
        roots = np.sqrt(squares.astype(np.float64))
    except OverflowError:
        roots = np.array([_huge_root(int(s)) for s in squares])
    return _up(roots) if up else _down(roots)


def _huge_root(square: int) -> float:
    half = max(0, (square.bit_length() - 120) // 2)
    root = (square >> 2 * half) ** 0.5
    try:
        return float(int(root) << half)
    except OverflowError:
        return float("inf")


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x * (1 + 2.0**-48)


def _down(x: np.ndarray) -> np.ndarray:
    return np.minimum(x * (1 - 2.0**-48), np.finfo(np.float64).max)


# ---------------------------------------------------------------- one round


@dataclass(frozen=True)
class Centres:
    """Centroids, half the distances between them rounded down, and how far each has moved, rounded up."""

    points: list[list[int]]
    moved: np.ndarray

    def halves(self) -> np.ndarray:
        k = len(self.points)
        return np.array([[0.0 if i == j else float(_root(self._one(i, j), False)[0]) / 2 for j in range(k)] for i in range(k)]).reshape(k, k)

    def _one(self, i: int, j: int) -> np.ndarray:
        return np.array([sum((a - b) ** 2 for a, b in zip(self.points[i], self.points[j], strict=True))], dtype=object)


def nearest(vectors: np.ndarray, centres: Centres, halves: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, upper, lower bounds, how many distances were worked out)."""
    own, k, worked = own.copy(), len(centres.points), 0
    upper = _up(upper + centres.moved[own])
    lower = np.maximum(_down(lower - centres.moved), 0.0)
    others = halves + np.diag(np.full(k, np.inf))
    open_rows = np.flatnonzero(~(others.min(axis=1)[own] > upper))
    best = np.empty(len(own), dtype=object if vectors.dtype == object else np.int64)
    if len(open_rows):  # make the upper bounds of these rows tight
        for c in np.unique(own[open_rows]):
            rows = open_rows[own[open_rows] == c]
            exact = squared(vectors[rows], centres.points[c])
            best = best.astype(object) if exact.dtype == object else best
            best[rows], upper[rows], lower[rows, c] = exact, _root(exact, True), _root(exact, False)
            worked += len(rows)
    for c in range(k):
        rows = open_rows[own[open_rows] != c]
        rows = rows[~(lower[rows, c] > upper[rows]) & ~(halves[own[rows], c] > upper[rows])]
        if not len(rows):
            continue
        exact = squared(vectors[rows], centres.points[c])
        best = best.astype(object) if exact.dtype == object else best
        lower[rows, c] = _root(exact, False)
        worked += len(rows)
        closer = ((exact < best[rows]) | ((exact == best[rows]) & (c < own[rows]))).astype(bool)
        won = rows[closer]
        own[won], best[won], upper[won] = c, exact[closer], _root(exact[closer], True)
    return own, upper, lower, worked


class Sums:
    """Sums of the vectors of each cluster, as digits that can be added up anywhere."""

    def __init__(self) -> None:
        self.totals: dict[int, list] = {}

    def add(self, vectors: np.ndarray, own: np.ndarray) -> None:
        for c in np.unique(own):
            rows = vectors[own == c]
            count, total = self.totals.get(int(c), (0, 0))
            self.totals[int(c)] = [count + len(rows), total + rows.sum(axis=0).astype(object)]

    def digits(self) -> list[dict]:
        out = []
        for c, (count, total) in self.totals.items():
            out.append({"cluster": c, "place": -1, "digit": 0, "total": count})
            for place, value in enumerate(total):
                digit = 0
                while True:
                    rest, low = int(value) >> DIGIT, int(value) & ((1 << DIGIT) - 1)
                    if rest in (0, -1):  # the last digit carries the sign
                        out.append({"cluster": c, "place": place, "digit": digit, "total": int(value)})
                        break
                    out.append({"cluster": c, "place": place, "digit": digit, "total": low})
                    value, digit = rest, digit + 1
        return out


DIGITS = "array<struct<cluster:int,place:int,digit:int,total:long>>"
STATE = f"vec_id {{id}}, vector binary, cluster int, upper double, lower binary, distance long, worked long, sums {DIGITS}"
_PLACES = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("total", pa.int64())]))


def _rows_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class Clustering:
    """Centroids of ``vectors``, and the cluster of each after a number of rounds.

    ``vector`` holds arrays of numbers; only rows of exactly ``size`` components,
    none null, NaN or infinite, take part.  Each component x is floor(scale * x).
    Rows that repeat take part as often as they occur.  Further columns are
    ignored.  The first centroids are those with the smallest ``seeding`` text;
    ties (repeated ids) go by the components.  With fewer vectors than ``k``,
    there is a centroid for each; with none, no rows.
    """

    def __init__(self, vectors: DataFrame, k: int, seeding: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64):
        self.spark = prepare(vectors.sparkSession)
        self.scratch, self.size, self.k, self.worked = Scratch(self.spark, "elkan"), size, k, []
        self.id_type = vectors.schema[id_col].dataType
        self.state = STATE.format(id=self.id_type.simpleString())
        value = F.col(vector_col)
        finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is larger than infinity to Spark
        kept = vectors.where((F.size(value) == size) & finite).select(F.col(id_col).alias("vec_id"), value.cast("array<double>").alias("vector"), seeding.alias("seed"))

        def pack(batches):
            for batch in _rows_of_batches(batches):
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                whole = scaled_floors(values, scale)
                yield pa.record_batch([batch.column(0), pa.array([packed(row) for row in whole], pa.binary()), batch.column(2)], ["vec_id", "vector", "seed"])

        self.table = self.scratch.table(kept.mapInArrow(pack, f"vec_id {self.id_type.simpleString()}, vector binary, seed string"), "vectors")
        seeds = self.table.orderBy("seed", "vector").limit(k).select("vector").collect()
        points = [[int(x) for x in unpacked([bytes(r.vector)], size)[0]] for r in seeds]
        self.centres = Centres(points, np.zeros(len(points)))
        self.round = 0

    def _pass(self, last: bool) -> DataFrame:
        """The table of vectors after each went to its nearest centroid; the last time with exact distances."""
        centres, size, first = self.centres, self.size, self.round == 0
        k, halves = len(centres.points), centres.halves()

        def work(batches):
            sums, worked, names = Sums(), 0, [f.split(" ")[0] for f in self_state]
            for batch in _rows_of_batches(batches):
                n = batch.num_rows
                vectors = unpacked(batch.column(1).to_pylist(), size)
                if first:
                    own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                else:
                    own, upper = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
                    lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f4").reshape(n, k).astype(np.float64)
                own, upper, lower, done = nearest(vectors, centres, halves, own, upper, lower)
                worked += done
                sums.add(vectors, own)
                distances = pa.nulls(n, pa.int64())
                if last:
                    exact = np.zeros(n, dtype=object)
                    for c in np.unique(own):
                        exact[own == c] = squared(vectors[own == c], centres.points[c])
                    distances = pa.array([int(d) if d <= LONGEST else None for d in exact], pa.int64())
                with np.errstate(over="ignore"):  # kept in four bytes, rounded down
                    low = np.nextafter(lower.astype("<f4"), np.float32(0), dtype=np.float32).astype("<f4") if not last else None
                bounds = pa.nulls(n, pa.binary()) if last else pa.array([row.tobytes() for row in np.minimum(low, np.finfo(np.float32).max)], pa.binary())
                yield pa.record_batch(
                    [batch.column(0), pa.nulls(n, pa.binary()) if last else batch.column(1), pa.array(own, pa.int32()), pa.array(upper), bounds, distances, pa.nulls(n, pa.int64()), pa.nulls(n, _PLACES)], names
                )
                give_back()
            if sums.totals:
                yield pa.record_batch(
                    [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([worked]), pa.array([sums.digits()], _PLACES)], names
                )

        self_state = self.state.split(", ")
        id_type = _arrow_type(self.id_type)
        rows = self.table.select("vec_id", "vector") if first else self.table.where(F.col("worked").isNull()).select("vec_id", "vector", "cluster", "upper", "lower")
        return rows.mapInArrow(work, self.state)

    def _step(self, last: bool) -> None:
        written = self.scratch.table(self._pass(last), f"round{self.round}")
        if self.round:
            self.scratch.free(f"round{self.round - 1}")
        else:
            self.scratch.free("vectors")
        self.table, self.round = written, self.round + 1
        self.worked.append(written.agg(F.sum("worked").alias("n")).first().n or 0)

    def run(self, rounds: int) -> Clustering:
        """So many rounds of going to the nearest centroid and moving centroids; then vectors go once more."""
        for _ in range(rounds):
            self._step(last=False)
            self._move()
        self._step(last=True)
        return self

    def _move(self) -> None:
        parts = self.table.where(F.col("worked").isNotNull()).select(F.explode("sums").alias("s")).select("s.*")
        rows = parts.groupBy("cluster", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x components x digits
        counts = {r.cluster: int(r.total) for r in rows if r.place < 0}
        totals = {c: [0] * self.size for c in counts}
        for r in rows:
            if r.place >= 0:
                totals[r.cluster][r.place] += int(r.total) << (DIGIT * r.digit)
        before = self.centres.points
        points = [[s // counts[c] for s in totals[c]] if c in counts else p for c, p in enumerate(before)]
        moved = [_root(np.array([sum((a - b) ** 2 for a, b in zip(p, q, strict=True))], dtype=object), True)[0] for p, q in zip(before, points, strict=True)]
        self.centres = Centres(points, np.array(moved, dtype=np.float64))

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; a number that is over a long is null."""
        rows = self.table.where(F.col("worked").isNull())
        lost = F.max(F.col("distance").isNull()).alias("lost")
        sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), lost).collect()  # a row for each cluster
        whole = sum(int(r.total or 0) for r in sums)
        whole = None if whole > LONGEST or any(r.lost for r in sums) else whole
        facts = [
            Row(cluster=r.cluster, cluster_inertia=None if r.lost or int(r.total) > LONGEST else int(r.total), inertia=whole, centroid_sha256=hashlib.sha256(",".join(map(str, self.centres.points[r.cluster])).encode()).hexdigest())
            for r in sums
        ]
        schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
        known = self.spark.createDataFrame(facts, schema)
        return rows.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clusters(vectors: DataFrame, *, k: int, rounds: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """The cluster of each vector; first centroids by the SHA-256 of the seed and the id's text (a null id has none)."""
    seeding = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return Clustering(vectors, k, seeding, id_col=id_col, vector_col=vector_col, size=size, scale=scale).run(rounds).assigned()
