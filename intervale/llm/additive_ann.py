"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several full-
dimensional codebooks.  The codebooks are fitted to residuals on a bounded
sample and refined together by least squares; every vector is encoded by beam
search and keeps its codes and the squared norm of their sum.  All of this is
on vectors less the sample's mean and over its spread, which leaves the order of
distances as it is, so that single precision does for scores.  A query makes a
table of its products with all codewords; a candidate's score is its norm less
twice the sum of its codes' entries.  The best by score are ranked again by the
exact distance on the original vectors.  Equal vectors are one class, coded and
scored once; a class stands for its rows with the smallest ids.

Queries come in blocks of bounded size, each against all rows of the index;
each task keeps its best for every query, so what moves is bounded by queries
and tasks, not by pairs.  The number ranked again grows with the square root of
the table.  With ``exact``, all vectors are passed once more against each
block, and whatever is nearer than the last one found joins in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, prepare

QUERY_BLOCK = 4096
INDEX_CHUNK = 8192


@dataclass(frozen=True)
class Frame:
    """Where vectors are seen from: scores take (x / unit - mean) / spread."""

    unit: float
    mean: np.ndarray
    spread: float

    @staticmethod
    def of(sample: np.ndarray) -> Frame:
        unit = float(np.abs(sample).max(initial=0.0)) or 1.0
        x = sample / unit
        mean = x.mean(axis=0)
        return Frame(unit, mean, float(np.sqrt(((x - mean) ** 2).mean())) or 1.0)

    def see(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x / self.unit - self.mean) / self.spread, -1e15, 1e15).astype(np.float32)


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # [books, size, dims] float32

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes [n, books] uint8, squared norm of each sum), by beam search over the books in order."""
        books, size, dims = self.words.shape
        n = len(x)
        rest = x.reshape(n, 1, dims)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        cost = (rest**2).sum(axis=2)
        for m in range(books):
            words = self.words[m]
            total = (cost[:, :, None] + (words**2).sum(axis=1) - 2 * rest @ words.T).reshape(n, -1)
            keep = min(beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = np.take_along_axis(total, best, axis=1)
            from_beam, word = best // size, best % size
            codes = np.concatenate((np.take_along_axis(codes, from_beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)), axis=2)
            rest = np.take_along_axis(rest, from_beam[:, :, None], axis=1) - words[word]
        first = np.argmin(cost, axis=1)
        sums = x - rest[np.arange(n), first]
        return codes[np.arange(n), first], (sums.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)


def _means(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(nearest, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        live = count > 0
        centres[live] = sums[live] / count[live, None]
        if (~live).any():
            centres[~live] = x[rng.choice(len(x), int((~live).sum()))]
    return centres


def fit_codebooks(sample: np.ndarray, *, books: int = 32, size: int = 64, rounds: int = 6, refine: int = 2, beam: int = 4, seed: int = 7) -> Codebooks:
    x = sample.astype(np.float32)
    rng = np.random.default_rng(seed)
    rest, words = x.copy(), []
    for _ in range(books):
        centres = _means(rest, size, rounds, rng)
        rest = rest - centres[np.argmin((centres**2).sum(axis=1) - 2 * rest @ centres.T, axis=1)]
        words.append(centres)
    model = Codebooks(np.stack(words))
    for _ in range(refine):  # codewords that fit the sample best given its codes
        codes, _ = model.encode(x, beam)
        places = codes.astype(np.int64) + np.arange(books) * size
        total = books * size
        left = np.zeros(total * total)
        right = np.zeros((total, x.shape[1]))
        for m in range(books):
            np.add.at(right, places[:, m], x)
            left += np.bincount((places[:, m, None] * total + places).ravel(), minlength=total * total)
        left = left.reshape(total, total)
        left[np.diag_indices(total)] += 0.1
        flat = np.linalg.solve(left, right + 0.1 * model.flat)
        model = Codebooks(flat.reshape(model.words.shape).astype(np.float32))
    return model


def best_of(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` smallest scores, ties to the smaller id, in that order."""
    if len(score) > keep:
        edge = np.partition(score, keep - 1)[keep - 1]
        under = np.flatnonzero(score < edge)
        ties = np.flatnonzero(score == edge)
        ties = ties[np.argsort(ids[ties], kind="stable")][: keep - len(under)]
        places = np.concatenate((under, ties))
    else:
        places = np.arange(len(score))
    return places[np.lexsort((ids[places], score[places]))]


class Index:
    """All usable vectors of one table, coded.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than most.  Rows that repeat
    an id are rows of their own.
    """

    def __init__(self, table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 8192, beam: int = 6, books: int = 32, size: int = 64):
        spark = prepare(table.sparkSession)
        self.spark, self.scratch = spark, Scratch(spark, "ann")
        vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
        rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where("v is not null and vec_id is not null and size(v) > 0")
        fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)"
        lengths = rows.where(fine).groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
        self.dims = lengths[0].dims if lengths else 0
        landed = rows.where(f"{fine} and size(v) = {self.dims}").withColumn("row", F.monotonically_increasing_id())
        landed = landed.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})  # 128 bits name a class
        self.vectors = self.scratch.table(landed, "vectors")
        self.rows = lengths[0].n if lengths else 0
        if not self.rows:
            return
        drawn = self.vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) <= min(1 << 40, (sample << 40) // self.rows)).select("row", "v").orderBy("row").limit(2 * sample).toArrow()
        if not len(drawn):
            drawn = self.vectors.select("row", "v").orderBy("row").limit(sample).toArrow()
        found = drawn["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dims)
        self.frame = Frame.of(found)
        self.model = fit_codebooks(self.frame.see(found), books=books, size=min(size, len(found)))
        shared = spark.sparkContext.broadcast((self.model, self.frame))  # books x size x dims floats

        def encode(batches):
            model, frame = shared.value
            for batch in batches:
                x = frame.see(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                for at in range(0, len(x), 1024):
                    codes, norm = model.encode(x[at : at + 1024], beam)
                    yield pa.record_batch({"row": batch.column(0)[at : at + 1024], "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": norm, "vec_id": batch.column(2)[at : at + 1024]})

        least = F.min(F.struct("vec_id", "row"))
        classes = self.vectors.groupBy("h1", "h2").agg(least.alias("least")).select("h1", "h2", F.col("least.vec_id").alias("vec_id"), F.col("least.row").alias("row"))
        self.classes = self.scratch.table(classes, "classes")
        firsts = self.vectors.join(self.classes.select("row"), "row").select("row", "v", "vec_id")
        self.codes = self.scratch.table(firsts.mapInArrow(encode, "row long, codes binary, norm float, vec_id long"), "codes")

    def _block(self, queries: list, keep: int) -> DataFrame:
        """(query_row, row): the best classes of the whole index by score, ties to the smaller vec_id, for a bounded list of (row, vector)."""
        own = np.array([r for r, _ in queries], dtype=np.int64)
        shared = self.spark.sparkContext.broadcast((self.model, own, self.frame.see(np.array([v for _, v in queries], dtype=np.float64))))

        def score(batches):
            model, own, q = shared.value
            books, size, _ = model.words.shape
            table = np.ascontiguousarray((-2 * (q @ model.flat.T)).T)  # [codeword, query]
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(own)

            def take(rows, vec_ids, codes, norm):
                places = codes.astype(np.int64) + np.arange(books) * size
                for at in range(0, len(own), 256):
                    part = table[:, at : at + 256]
                    total = np.repeat(norm[:, None], part.shape[1], axis=1)
                    for m in range(books):
                        total += part[places[:, m]]
                    for j in range(part.shape[1]):
                        known, ids, old = held[at + j]
                        known, ids, new = np.concatenate((known, rows)), np.concatenate((ids, vec_ids)), np.concatenate((old, total[:, j]))
                        best = best_of(new, ids, keep)
                        held[at + j] = known[best], ids[best], new[best]

            for batch in batches:
                rows = batch.column(0).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, books)
                norm, vec_ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for at in range(0, len(rows), INDEX_CHUNK):
                    take(rows[at : at + INDEX_CHUNK], vec_ids[at : at + INDEX_CHUNK], codes[at : at + INDEX_CHUNK], norm[at : at + INDEX_CHUNK])
            for at in range(0, len(own), 256):
                some = range(at, min(at + 256, len(own)))
                yield pa.record_batch({
                    "query_row": own[at : at + 256],
                    "rows": pa.array([held[i][0].tobytes() for i in some], pa.binary()),
                    "vec_ids": pa.array([held[i][1].tobytes() for i in some], pa.binary()),
                    "scores": pa.array([held[i][2].tobytes() for i in some], pa.binary()),
                })

        def merge(batches):
            held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for query, rows, vec_ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    new = np.frombuffer(rows, np.int64), np.frombuffer(vec_ids, np.int64), np.frombuffer(scores, np.float32)
                    if query in held:
                        new = tuple(np.concatenate(x) for x in zip(held[query], new, strict=True))
                    best = best_of(new[2], new[1], keep)
                    held[query] = tuple(x[best] for x in new)
            for query, (rows, _, _) in held.items():
                yield pa.record_batch({"query_row": np.full(len(rows), query), "row": rows})

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        scored = self.codes.mapInArrow(score, "query_row long, rows binary, vec_ids binary, scores binary")
        return scored.repartition(parts, "query_row").mapInArrow(merge, "query_row long, row long")

    def _distances(self, queries: list, pairs: DataFrame) -> DataFrame:
        """(query_row, first, score) of pairs (query_row, row), exact, for the block's queries; each vector moves once."""
        shared = self.spark.sparkContext.broadcast(({r: i for i, (r, _) in enumerate(queries)}, np.array([v for _, v in queries], dtype=np.float64)))

        def measure(batches):
            place, q = shared.value
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for i, (row, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                    who = asked.values.to_numpy(zero_copy_only=False)
                    score = distances(q[[place[r] for r in who.tolist()]], v[i])
                    yield pa.record_batch({"query_row": who, "first": np.full(len(who), row), "score": score})

        wanted = pairs.groupBy("row").agg(F.collect_list("query_row").alias("asked"))  # at most a block of queries each
        firsts = self.vectors.join(self.classes.select("row"), "row").select("row", "v")
        return firsts.join(wanted, "row").select("row", "v", "asked").mapInArrow(measure, "query_row long, first long, score double")

    def _nearer(self, queries: list, kth: dict[int, float]) -> DataFrame:
        """(query_row, first, score) of all classes as near as each query's k-th so far, by a pass over all vectors."""
        shared = self.spark.sparkContext.broadcast((np.array([r for r, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64), np.array([kth.get(r, np.inf) for r, _ in queries])))

        def measure(batches):
            rows, q, limit = shared.value
            unit = max(float(np.abs(q).max(initial=0.0)), 1e-300)
            scaled = q / unit
            norms = (scaled**2).sum(axis=1)
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                ids = batch.column(0).to_numpy()
                for at in range(0, len(v), 1024):
                    with np.errstate(over="ignore", invalid="ignore"):
                        some = v[at : at + 1024] / unit
                        size = (some**2).sum(axis=1)[:, None] + norms
                        squares = size - 2 * some @ scaled.T
                        near = ~(squares > (limit / unit) ** 2 + 1e-9 * size)
                    who, whose = np.nonzero(near)
                    score = np.concatenate([distances(q[whose[i : i + 4096]], v[at + who[i : i + 4096]]) for i in range(0, len(who), 4096)] + [np.zeros(0)])
                    held = score <= limit[whose]
                    yield pa.record_batch({"query_row": rows[whose[held]], "first": ids[at + who[held]], "score": score[held]})

        firsts = self.vectors.join(self.classes.select("row"), "row").select("row", "v")
        return firsts.mapInArrow(measure, "query_row long, first long, score double")

    def search(self, queries: DataFrame, *, k: int = 10, rerank: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found by exact Euclidean distance, ties to the smaller id.

        ``queries`` are rows of ``self.vectors``; a query's own row is no candidate.
        ``rerank`` classes a query are measured, 1000 or four times the root of the
        number of rows if not said; with ``exact`` nothing nearer is left out.
        """
        if not self.rows:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        if rerank is None:
            rerank = max(1000, int(4 * self.rows**0.5))
        wanted = self.scratch.table(queries.select("row", "v"), "queries")
        scored, after = None, -1
        while True:
            block = [(r.row, r.v) for r in wanted.where(F.col("row") > after).orderBy("row").limit(QUERY_BLOCK).collect()]
            if not block:
                break
            after = block[-1][0]
            name = f"scored-{after}"
            found = self.scratch.table(self._distances(block, self._block(block, rerank + 1)), name)
            if exact:
                order = Window.partitionBy("query_row").orderBy("score", "first")
                last = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k + 1)
                kth = {r.query_row: r.score for r in last.select("query_row", "score").collect()}  # a row a query of the block
                found = self.scratch.table(self._nearer(block, kth), f"exact-{after}")
            scored = found if scored is None else scored.unionByName(found)
        if scored is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best = Window.partitionBy("query_row").orderBy("score", "first")
        scored = scored.withColumn("kth", F.nth_value("score", k + 1).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("kth is null or score <= kth")
        within = Window.partitionBy("h1", "h2").orderBy("vec_id", "row")
        members = self.vectors.select("h1", "h2", "vec_id", "row").withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= k + 1)
        members = members.join(self.classes.select("h1", "h2", F.col("row").alias("first")), ["h1", "h2"]).select("first", "vec_id", "row")
        ranked = scored.join(members, "first").where("row <> query_row").select("query_row", "vec_id", "row", "score")
        order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asked = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
        return ranked.join(asked, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, their squares summed from the first component on."""
    with np.errstate(over="ignore"):
        squares = (a - b) ** 2
        return np.sqrt(np.add.accumulate(squares, axis=1)[:, -1]) if squares.shape[1] else np.zeros(len(squares))


def nearest(table: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False, **options) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``, among all rows."""
    index = Index(table, id_col=id_col, vector_col=vector_col, **options)
    return index.search(index.vectors.where(F.col("vec_id") % every == 0), k=k, exact=exact)
