"""Language-model scores by deleted interpolation.

A text is its words, A-Z lower-cased, and one end token; the first token's
context is an end.  The probability of a token after a context is a mixture of
the bigram's, the token's and a uniform estimate, with weights that depend on
how often the context was seen.  The training documents are two folds: the
weights of each frequency bucket are learned by expectation-maximisation on the
counts of the smaller fold, given estimates from the other one alone; the final
estimates take both folds.

Counts are over all training documents, without cut-offs.  Words and bigrams
are known by 64-bit hashes.  Documents are gathered into chunks of a bounded
number of tokens; a chunk sends each distinct word and bigram once, as packed
columns cut by hash range, and gets back their counts in the same order.  So
neither the vocabulary nor the counts ever meet in one place, a very common
word costs an entry a chunk, and no table is larger than a range.  Chunks and
ranges grow with the square root of the tokens, so that the packed columns
between them hold many entries each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, give_back, prepare
from intervale.llm.unit_store import as_bytes, parts

#: Tokens of a chunk and of a range: at least, at most, and between them as many as make columns of so many entries.
LEAST_TOKENS, MOST_TOKENS, ENTRIES = 2_000_000, 16_000_000, 64
PART_BYTES = 4 << 20
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
HELD_OUT, MAIN, DELETED = 0, 1, 2
BUCKETS = 24
#: Steps of a probability's base-2 logarithm in the statistics that the weights are learned from.
STEPS = 8
WORD, PAIR, TOTALS = 1, 2, 0


# ---------------------------------------------------------------- packing


def _squash(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _planes(values: np.ndarray) -> bytes:
    return _squash(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unplanes(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- chunks


class Chunk:
    """Documents as token numbers in a vocabulary of hashes, in ascending order."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, folds: np.ndarray):
        self.vocabulary, self.tokens, self.lengths, self.folds = vocabulary, tokens, lengths, folds
        self.document = np.repeat(np.arange(len(lengths)), lengths)
        self.fold = folds[self.document]
        end = np.searchsorted(vocabulary, np.uint64(END))
        before = np.roll(tokens, 1)
        before[np.cumsum(lengths) - lengths] = end
        pairs = before.astype(np.int64) * len(vocabulary) + tokens
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.first, self.second = self.pairs // len(vocabulary), self.pairs % len(vocabulary)
        hashes = pair_hashes(vocabulary[self.first], vocabulary[self.second])
        self.by_hash = np.argsort(hashes, kind="stable")
        self.pair_hash = hashes[self.by_hash]

    def counts(self, places: np.ndarray, size: int) -> np.ndarray:
        """[size, 2] of the two training folds."""
        return np.column_stack([np.bincount(places[self.fold == f], minlength=size) for f in (MAIN, DELETED)]).astype(np.uint32)

    @staticmethod
    def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
        of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        return np.searchsorted(of, np.arange(ranges + 1))

    def sent(self, ranges: int):
        """(range, kind, hashes, counts), each sorted by hash."""
        words = self.counts(self.tokens, len(self.vocabulary))
        pairs = self.counts(self.pair, len(self.pairs))[self.by_hash]
        for kind, hashes, counts in ((WORD, self.vocabulary, words), (PAIR, self.pair_hash, pairs)):
            cuts = self.cuts(hashes, ranges)
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if a < b:
                    yield r, kind, hashes[a:b], counts[a:b]

    def received(self, answers: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of both folds for the vocabulary and for the pairs, from (kind, range, packed counts)."""
        out = {}
        for kind, size in ((WORD, len(self.vocabulary)), (PAIR, len(self.pairs))):
            parts = [_unplanes(data, np.uint64).reshape(-1, 2) for _, data in sorted((r, d) for k, r, d in answers if k == kind)]
            out[kind] = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
            if len(out[kind]) != size:
                raise RuntimeError("counts of a chunk are not complete")
        pairs = np.empty_like(out[PAIR])
        pairs[self.by_hash] = out[PAIR]
        return out[WORD].astype(np.int64), pairs.astype(np.int64)


CHUNK_FIELDS = "doc_ids array<long>, folds binary, lengths binary, vocabulary binary, tokens binary, n_tokens long"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of UTF-8 texts, A-Z lower-cased, an end after each text, and the number of tokens of each)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat, begin = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0  # white space at either end gives empty words
    coded = flat.dictionary_encode()
    distinct = as_bytes(coded.dictionary)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    stops = np.concatenate(([0], np.cumsum(real)))[begin]
    return np.insert(hashes[coded.indices.to_numpy()[real]], stops[1:], np.uint64(END)), np.diff(stops) + 1


def _gather(batches, chunk_tokens: int):
    """(doc_id, fold, text) batches -> rows of CHUNK_FIELDS."""
    ids, folds, lengths, hashes, held = [], [], [], [], 0

    def flush():
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        row = {
            "doc_ids": pa.array([sum(ids, [])], pa.list_(pa.int64())),
            "folds": pa.array([np.concatenate(folds).astype(np.uint8).tobytes()]),
            "lengths": pa.array([np.concatenate(lengths).astype(np.int32).tobytes()]),
            "vocabulary": pa.array([_pack_sorted(vocabulary)]),
            "tokens": pa.array([_planes(tokens.astype(np.uint32))]),
            "n_tokens": pa.array([held]),
        }
        return pa.record_batch(row)

    for batch in batches:
        at = 0
        for texts in parts(batch.column(2).fill_null(b""), PART_BYTES):
            found, counts = word_hashes(texts)
            ids.append(batch.column(0).slice(at, len(texts)).to_pylist())
            folds.append(batch.column(1).slice(at, len(texts)).to_numpy())
            lengths.append(counts)
            hashes.append(found)
            held += len(found)
            at += len(texts)
            if held >= chunk_tokens:
                yield flush()
                ids, folds, lengths, hashes, held = [], [], [], [], 0
                give_back()
    if ids:
        yield flush()
    ids, folds, lengths, hashes = [], [], [], []
    give_back()


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of both folds of each distinct hash as uint64, place of each hash given)."""
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    given = np.concatenate(counts).astype(np.float64)  # whole numbers up to 2**53 are exact
    return np.column_stack([np.bincount(place, given[:, f], len(distinct)) for f in (0, 1)]).astype(np.uint64), place


def _open(row: dict) -> Chunk:
    return Chunk(_unpack_sorted(row["vocabulary"]), _unplanes(row["tokens"], np.uint32).astype(np.int64), np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["folds"], np.uint8))


# ---------------------------------------------------------------- weights


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket for each doubling of the count."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)


def _steps(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(STEPS * np.log2(p)), 1).astype(np.int64)  # 1 stands for zero


def learn_weights(bucket: np.ndarray, pair: np.ndarray, word: np.ndarray, uniform: float, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """[bucket, (pair, word, uniform)] by expectation-maximisation over events with their counts n.

    A bucket without events takes the weights of all events together.
    """

    def learn(rows: np.ndarray, no_pair: bool) -> np.ndarray:
        p = np.column_stack((pair[rows], word[rows], np.full(int(rows.sum()), uniform)))
        w = np.array([0.0 if no_pair else 0.5, 0.4, 0.1])
        w /= w.sum()
        for _ in range(rounds):
            joint = p * w
            joint *= (n[rows] / joint.sum(axis=1))[:, None]
            w = joint.sum(axis=0) + np.array([0.0 if no_pair else 0.1, 0.1, 0.1])
            w /= w.sum()
        return w

    whole = learn(bucket > 0, False)
    out = np.tile(whole, (BUCKETS, 1))
    for b in range(BUCKETS):
        if b == 0 or (bucket == b).any():
            out[b] = learn(bucket == b, b == 0)
    return out


@dataclass(frozen=True)
class Totals:
    tokens: int  # of all training documents
    words: int  # distinct, the end token included
    main_tokens: int


# ---------------------------------------------------------------- Spark


class InterpolatedModel:
    """A model of the documents whose fold isn't held out, and the scores of all documents.

    ``fold`` is a column of 0 (scored only), 1 (main counts) or 2 (counts that
    the weights are learned from).  A null text counts as empty, that is one end
    token.  Rows that repeat keep a row each; further columns are ignored.
    Without training documents every token is unknown.
    """

    def __init__(self, docs: DataFrame, fold: Column, *, id_col: str = "doc_id", text_col: str = "text"):
        spark = prepare(docs.sparkSession)
        self.spark, self.scratch = spark, Scratch(spark, "lm")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.cast("int").alias("fold"), F.col(text_col).cast("binary").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        self.most = int(min(MOST_TOKENS, max(LEAST_TOKENS, math.sqrt(ENTRIES * size / 6))))
        most = self.most
        chunks = rows.mapInArrow(lambda batches: _gather(batches, most), CHUNK_FIELDS).withColumn("chunk", F.monotonically_increasing_id())
        self.chunks = self.scratch.table(chunks, "chunks")
        self._count()
        self._learn()

    def _count(self) -> None:
        found = self.chunks.agg(F.sum("n_tokens").alias("n"), F.max(F.shiftright("chunk", 33)).alias("file"), F.max(F.expr("chunk & 8589934591")).alias("nth")).first()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, (found.n or 0) // self.most)
        # Chunks are dealt one by one: the first of each file, the second of each, and so on.
        files, nth = (found.file or 0) + 1, (found.nth or 0) + 1
        self.place = F.expr(f"(chunk & 8589934591) * {files} + shiftright(chunk, 33)")
        self.tasks = min(files * nth, max(least, files * nth // 4))

        def send(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    found = [(r, row["chunk"], kind, _pack_sorted(hashes), _planes(counts.ravel())) for r, kind, hashes, counts in _open(row).sent(ranges)]
                    columns = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "kind", "hashes", "counts"])

        def add(batches):
            asked: dict[int, list] = {WORD: [], PAIR: []}
            for batch in batches:
                for part, chunk, kind, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    asked[kind].append((part, chunk, _unpack_sorted(hashes), _unplanes(counts, np.uint32).reshape(-1, 2)))
            for kind, rows in asked.items():
                if not rows:
                    continue
                sums, place = summed([h for _, _, h, _ in rows], [c for *_, c in rows])
                at = 0
                for part, chunk, hashes, _ in rows:
                    answer = sums[place[at : at + len(hashes)]]
                    at += len(hashes)
                    yield pa.record_batch({"chunk": [chunk], "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "counts": [_planes(answer.ravel())], "words": [0], "main": [0], "deleted": [0]})
                if kind == WORD:
                    yield pa.record_batch({"chunk": [-1], "kind": pa.array([TOTALS], pa.int32()), "part": pa.array([0], pa.int32()), "counts": [b""], "words": [int((sums.sum(axis=1) > 0).sum())], "main": [int(sums[:, 0].sum())], "deleted": [int(sums[:, 1].sum())]})

        sent = self.chunks.mapInArrow(send, "part int, chunk long, kind int, hashes binary, counts binary").repartitionById(ranges, F.col("part"))
        answers = sent.mapInArrow(add, "chunk long, kind int, part int, counts binary, words long, main long, deleted long")
        self.answers = self.scratch.table(answers, "answers")
        sums = self.answers.where(F.col("kind") == TOTALS).agg(F.sum("words").alias("words"), F.sum("main").alias("main"), F.sum("deleted").alias("deleted")).first()
        main, deleted = sums.main or 0, sums.deleted or 0
        self.totals = Totals(main + deleted, sums.words or 0, main)

    def _with_answers(self, work: Callable, kinds: str) -> DataFrame:
        """Rows of ``work(chunk, doc_ids, counts of its words, counts of its pairs)`` over all chunks, each met with its answers."""
        chunks = self.chunks.drop("n_tokens").withColumn("kind", F.lit(None).cast("int"))
        answers = self.answers.where(F.col("kind") != TOTALS).select("chunk", "kind", "part", "counts")
        rows = chunks.unionByName(answers, allowMissingColumns=True).withColumn("to", self.place)
        dealt = rows.repartitionById(self.tasks, F.pmod(F.col("to"), F.lit(self.tasks)).cast("int")).drop("to").sortWithinPartitions("chunk")

        def meet(batches):
            now, own, answers = None, None, []

            def done():
                chunk = _open(own)
                yield work(chunk, own["doc_ids"], *chunk.received(answers))

            for batch in batches:
                for row in batch.to_pylist():
                    if row["chunk"] != now and own is not None:
                        yield from done()
                    if row["chunk"] != now:
                        now, own, answers = row["chunk"], None, []
                        give_back()
                    if row["kind"] is None:
                        own = row
                    else:
                        answers.append((row["kind"], row["part"], row["counts"]))
            if own is not None:
                yield from done()
            own, answers = None, []
            give_back()

        return dealt.mapInArrow(meet, kinds)

    def _learn(self) -> None:
        totals = self.totals

        def events(chunk, _, words, pairs):
            n = np.bincount(chunk.pair[chunk.fold == DELETED], minlength=len(chunk.pairs))
            live = np.flatnonzero(n)
            context = words[chunk.first[live], 0]
            pair = np.where(context > 0, pairs[live, 0] / np.maximum(context, 1), 0.0)
            word = words[chunk.second[live], 0] / max(1, totals.main_tokens)
            keys = np.column_stack((bucket_of(context), _steps(pair), _steps(word)))
            cells, place = np.unique(keys, axis=0, return_inverse=True)
            sums = np.bincount(place.ravel(), n[live], len(cells)).astype(np.int64)
            return pa.record_batch({"bucket": cells[:, 0], "pair": cells[:, 1], "word": cells[:, 2], "n": sums})

        # A row for each cell of a fixed grid that occurs.
        cells = self._with_answers(events, "bucket long, pair long, word long, n long").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
        found = cells.orderBy("bucket", "pair", "word").toArrow()
        bucket, pair, word, n = (found[c].to_numpy() for c in ("bucket", "pair", "word", "n"))
        value = lambda steps: np.where(steps > 0, 0.0, 2.0 ** (steps / STEPS))
        self.weights = learn_weights(bucket, value(pair), value(word), 1 / (totals.words + 1), n.astype(np.float64))
        if not totals.tokens:
            self.weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def scores(self) -> DataFrame:
        """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
        totals, weights = self.totals, self.weights

        def score(chunk, doc_ids, words, pairs):
            words, pairs = words.sum(axis=1), pairs.sum(axis=1)
            context = words[chunk.first]
            w = weights[bucket_of(context)]
            p = w[:, 0] * pairs / np.maximum(context, 1) + w[:, 1] * words[chunk.second] / max(1, totals.tokens) + w[:, 2] / (totals.words + 1)
            base = np.log10((words + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
            at, size = chunk.document, len(chunk.lengths)
            return pa.record_batch({
                "doc_id": pa.array(doc_ids, pa.int64()),
                "fold": chunk.folds.astype(np.int32),
                "n_tokens": chunk.lengths.astype(np.int64),
                "n_known": np.bincount(at, words[chunk.tokens] > 0, size).astype(np.int64),
                "train_tokens": np.full(size, totals.tokens),
                "base_score": np.bincount(at, base[chunk.tokens], size),
                "score": np.bincount(at, np.log10(p)[chunk.pair], size),
            })

        return self._with_answers(score, "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def interpolated_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remainder: Column) -> DataFrame:
    """Scores of all documents; remainder 0 is held out and 1 is the fold that the weights are learned from."""
    fold = F.when(remainder == 0, HELD_OUT).when(remainder == 1, DELETED).otherwise(MAIN)
    found = InterpolatedModel(docs, fold, id_col=id_col, text_col=text_col).scores()
    return found.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
