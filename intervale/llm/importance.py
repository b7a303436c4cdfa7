"""Documents drawn to look like a target text, by hashed n-gram importance weights.

Features are runs of one to three words.  How often each bucket of features
occurs in the documents and in the target gives the bucket's gain; a document's
weight is the sum of its features' gains, and weight plus Gumbel noise of its id
ranks the documents.

Features go through a dictionary of distinct strings.  Documents are gathered
into chunks of a bounded number of words, and a chunk sends each distinct word,
pair and triple once, with its count.  A feature's range (by the hash of its
first two words) brings all its chunks' counts together, so a string's global count
is known there; there each distinct string is hashed once, from its words' checksums,
and counted to its bucket.  What goes back to a chunk is the bucket of each of its
features, in the order in which they were sent; the chunk meets them with the
features of each of its documents.

Strings are exact: a block of features carries the words that it uses, and
features are numbers into them.  A very common word, line or document costs an entry
a chunk; no group of rows is gathered by a key.  Neither vocabulary nor counts
meet in one place; only the bounded table of buckets comes to the driver.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, give_back, prepare
from intervale.llm.unit_store import parts

#: Words of a chunk and of a range: at least, at most, and between them as many as make blocks of so many features.
LEAST_WORDS, MOST_WORDS, ENTRIES = 3_000_000, 8_000_000, 256
PART_BYTES = 4 << 20
#: Words are nearly half of what a block sends.
WORDS_LEVEL = 6
ANSWER, TOTALS = 0, 1
#: Rows of a task that ranks.
RANKED_ROWS = 1_000_000

#: What a byte of a text becomes: words are digits, letters and all that is not ASCII, capitals lower-cased; the rest parts them.
FOLD = np.full(256, ord(" "), dtype=np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[_first : _last + 1] = np.arange(_first, _last + 1)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


# ---------------------------------------------------------------- words


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, number of words of each text) of UTF-8 texts without nulls."""
    size = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + size + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    folded = pa.Array.from_buffers(pa.string(), size, [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(FOLD[data])])
    words = pc.ascii_split_whitespace(folded)
    flat, begin = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0  # white space at either end gives empty words
    coded = flat.filter(pa.array(real)).dictionary_encode()
    stops = np.concatenate(([0], np.cumsum(real)))[begin]
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False), np.diff(stops)


def merged(dictionaries: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """(distinct words in ascending order, place of each word of each dictionary among them)."""
    coded = pa.concat_arrays(dictionaries).dictionary_encode() if dictionaries else pa.array([], pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    whole = place[coded.indices.to_numpy(zero_copy_only=False)]
    return coded.dictionary.take(pa.array(order)), np.split(whole, np.cumsum([len(d) for d in dictionaries])[:-1])


# ---------------------------------------------------------------- checksums


@cache
def _shifts(power: int) -> np.ndarray:
    """[4, 256] tables: what a CRC-32 becomes when 2**power zero bytes follow, a byte of it at a time."""
    if power == 0:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        columns = [(1 << bit >> 8) ^ int(table[(1 << bit) & 255]) for bit in range(32)]
    else:
        half = _shifts(power - 1)
        once = _through(half, (np.uint32(1) << np.arange(32, dtype=np.uint32)))
        columns = _through(half, once).tolist()
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, np.arange(256) >> bit & 1 == 1] ^= np.uint32(columns[8 * byte + bit])
    return out


def _through(tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return tables[0][sums & 255] ^ tables[1][sums >> 8 & 255] ^ tables[2][sums >> 16 & 255] ^ tables[3][sums >> 24]


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of their parts and the second ones' numbers of bytes."""
    out = first.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        rows = np.flatnonzero(lengths >> power & 1)
        out[rows] = _through(_shifts(power), out[rows])
    return out ^ second


class Checksums:
    """CRC-32 of words, and of words joined by a space."""

    def __init__(self, words: pa.Array):
        distinct = words.to_pylist()
        # A space before the word, as it stands behind another one.
        self.alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        self.behind = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))
        self.lengths = pc.binary_length(words).to_numpy().astype(np.int64) + 1

    def extended(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return joined_crc(before, self.behind[word], self.lengths[word])


# ---------------------------------------------------------------- packing


def _squash(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray, kind=np.uint32) -> bytes:
    return _squash(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes())


def _unplanes(data: bytes, kind=np.uint32, wanted=np.int64) -> np.ndarray:
    raw = np.frombuffer(_open(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind).astype(wanted)


def _steps(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=0))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data))


# ---------------------------------------------------------------- chunks


class Features:
    """Distinct words, pairs and triples of a chunk, in ascending order, and where each occurs."""

    def __init__(self, words: pa.Array, tokens: np.ndarray, lengths: np.ndarray, ranges: int):
        self.words, self.lengths = words, lengths
        size = len(words)
        document = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        two, three = document[:-1] == document[1:], document[:-2] == document[2:]
        pairs, at_two = _distinct(tokens[:-1][two], tokens[1:][two], size)
        self.first, self.second = pairs
        pair_at = np.zeros(len(tokens), np.int32)
        pair_at[:-1][two] = at_two
        triples, at_three = _distinct(pair_at[:-2][three], tokens[2:][three], size)
        self.pair, self.third = triples
        del pair_at
        #: Of words, pairs and triples: the document and the feature of each occurrence.
        self.found = [(document, tokens), (document[:-1][two], at_two), (document[:-2][three], at_three)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, size)
        one_range = _range_of(hashes, ranges)
        pair_range = _range_of(hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.second], ranges)
        self.ranges = [one_range, pair_range, pair_range[self.pair]]
        #: Features by range, those of a range in ascending order.
        self.orders = [np.argsort(r, kind="stable").astype(np.int32) for r in self.ranges]

    def counts(self) -> list[np.ndarray]:
        return [np.bincount(which, minlength=len(r)) for (_, which), r in zip(self.found, self.ranges, strict=True)]

    def blocks(self, ranges: int):
        """(range, words, words' numbers, first, second, triples of each pair, third, counts): packed features of each range."""
        counts = self.counts()
        cuts = [np.searchsorted(r[o], np.arange(ranges + 1)) for r, o in zip(self.ranges, self.orders, strict=True)]
        fan = np.bincount(self.pair, minlength=len(self.first))
        for r in range(ranges):
            one, two, three = (o[c[r] : c[r + 1]] for o, c in zip(self.orders, cuts, strict=True))
            if not len(one) and not len(two):
                continue
            first, second, third = self.first[two], self.second[two], self.third[three]
            used = np.unique(np.concatenate((one, first, second, third)))
            local = lambda x, used=used: np.searchsorted(used, x)
            spoken = b"\n".join(self.words.take(pa.array(used)).to_pylist())
            yield r, _squash(spoken, WORDS_LEVEL), _steps(local(one)), _steps(local(first)), _planes(local(second)), _planes(fan[two]), _planes(local(third)), _planes(np.concatenate([n[x] for n, x in zip(counts, (one, two, three), strict=True)]))

    def weights(self, answers: list[tuple[int, bytes]], gains: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, sum of gains) of each document, from the (range, packed buckets) that came back."""
        got: list[list[np.ndarray]] = [[], [], []]
        cuts = [np.searchsorted(r[o], np.arange(max((p for p, _ in answers), default=0) + 2)) for r, o in zip(self.ranges, self.orders, strict=True)]
        for part, data in sorted(answers):
            buckets = _unplanes(data, kind, kind)
            sizes = [int(c[part + 1] - c[part]) for c in cuts]
            if sum(sizes) != len(buckets):
                raise RuntimeError("buckets of a chunk do not match its features")
            for pieces, piece in zip(got, np.split(buckets, np.cumsum(sizes)[:-1]), strict=True):
                pieces.append(piece)
        number, weight = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths))
        for order, pieces, (document, which) in zip(self.orders, got, self.found, strict=True):
            gain = np.empty(len(order))
            found = np.concatenate(pieces) if pieces else np.zeros(0, kind)
            if len(found) != len(order):
                raise RuntimeError("buckets of a chunk are not complete")
            gain[order] = gains[found]
            number += np.bincount(document, minlength=len(number))
            weight += np.bincount(document, gain[which], len(number))  # whole numbers: exact up to 2**53
        return number, weight.astype(np.int64)


def _distinct(left: np.ndarray, right: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((left, right) of the distinct pairs in ascending order, place of each pair among them); right is below size."""
    codes = left.astype(np.int64) * size
    codes += right
    found, place = np.unique(codes, return_inverse=True)
    return ((found // max(1, size)).astype(np.int32), (found % max(1, size)).astype(np.int32)), place.astype(np.int32)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((mixed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


CHUNK = "ids array<long>, lengths binary, words binary, often binary, tokens binary, n_words long"


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Words in the order in which a chunk numbers them in its texts: frequent ones first, so that their numbers pack well."""
    return np.argsort(-counts, kind="stable").astype(np.int32)


def _gather(batches, chunk_words: int):
    """(id, text) batches -> rows of CHUNK."""
    ids, lengths, dictionaries, tokens, held = [], [], [], [], 0

    def flush():
        words, places = merged(dictionaries)
        whole = np.concatenate([p[t] for p, t in zip(places, tokens, strict=True)])
        often = np.bincount(whole, minlength=len(words))
        rank = np.empty(len(words), np.int32)
        rank[by_frequency(often)] = np.arange(len(words))
        row = {
            "ids": pa.array([sum(ids, [])], pa.list_(pa.int64())),
            "lengths": pa.array([_planes(np.concatenate(lengths))]),
            "words": pa.array([_squash(b"\n".join(words.to_pylist()))]),
            "often": pa.array([_planes(often)]),
            "tokens": pa.array([_planes(rank[whole])]),
            "n_words": pa.array([held]),
        }
        return pa.record_batch(row)

    for batch in batches:
        at = 0
        for texts in parts(batch.column(1).fill_null(b""), PART_BYTES):
            found, places, counts = split_words(texts)
            ids.append(batch.column(0).slice(at, len(texts)).to_pylist())
            dictionaries.append(found)
            tokens.append(places)
            lengths.append(counts)
            held += len(places)
            at += len(texts)
            if held >= chunk_words:
                yield flush()
                ids, lengths, dictionaries, tokens, held = [], [], [], [], 0
                give_back()
    if ids:
        yield flush()
    ids, lengths, dictionaries, tokens = [], [], [], []
    give_back()


def _words(data: bytes) -> pa.Array:
    raw = _open(data)
    return pa.array(raw.split(b"\n") if raw else [], pa.binary())


def _features(row: dict, ranges: int) -> Features:
    tokens = by_frequency(_unplanes(row["often"]))[_unplanes(row["tokens"], wanted=np.int32)]
    return Features(_words(row["words"]), tokens, _unplanes(row["lengths"]), ranges)


def _count_range(blocks: list[tuple], buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(occurrences of each bucket, buckets of the features of each block) of all blocks of a range."""
    words, places = merged([_words(b[0]) for b in blocks])
    size = max(1, len(words))
    sums = Checksums(words)
    ones = [p[_unsteps(b[1])] for p, b in zip(places, blocks, strict=True)]
    firsts = [p[_unsteps(b[2])] for p, b in zip(places, blocks, strict=True)]
    pairs = [f * size + p[_unplanes(b[3])] for f, p, b in zip(firsts, places, blocks, strict=True)]
    fans = [_unplanes(b[4]) for b in blocks]
    thirds = [p[_unplanes(b[5])] for p, b in zip(places, blocks, strict=True)]
    counts = [np.split(_unplanes(b[6]), np.cumsum((len(o), len(f)))) for b, o, f in zip(blocks, ones, firsts, strict=True)]
    place_of_one, each_one = np.unique(np.concatenate(ones), return_inverse=True)
    distinct_pairs, each_pair = np.unique(np.concatenate(pairs), return_inverse=True)
    triples = np.repeat(each_pair, np.concatenate(fans)) * size + np.concatenate(thirds)
    distinct_triples, each_triple = np.unique(triples, return_inverse=True)
    pair_sums = sums.extended(sums.alone[distinct_pairs // size], distinct_pairs % size)
    triple_sums = sums.extended(pair_sums[distinct_triples // size], distinct_triples % size)
    total = np.zeros(buckets)
    answers: list[list[np.ndarray]] = []
    for kind, (crc, each, sizes) in enumerate(((sums.alone[place_of_one], each_one, ones), (pair_sums, each_pair, firsts), (triple_sums, each_triple, thirds))):
        bucket = (crc % buckets).astype(np.int64)
        known = np.bincount(each, np.concatenate([c[kind] for c in counts]), len(bucket))  # each string's global count
        total += np.bincount(bucket, known, buckets)
        answers.append(np.split(bucket[each], np.cumsum([len(s) for s in sizes])[:-1]))
    return total.astype(np.int64), [np.concatenate(a) for a in zip(*answers, strict=True)]


class FeatureCounts:
    """How often the features of a table's texts occur by bucket, and weights of its rows.

    A null text has no words.  Rows that repeat count as often as they occur;
    further columns are ignored; an empty table has all counts zero.
    """

    def __init__(self, table: DataFrame, *, buckets: int, id_col: str, text_col: str = "text"):
        self.spark = prepare(table.sparkSession)
        self.scratch, self.buckets = Scratch(self.spark, "importance"), buckets
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        most = self.most = int(min(MOST_WORDS, max(LEAST_WORDS, math.sqrt(ENTRIES * size / 6))))
        chunks = rows.mapInArrow(lambda batches: _gather(batches, most), CHUNK).withColumn("chunk", F.monotonically_increasing_id())
        self.chunks = self.scratch.table(chunks, "chunks")
        self._count()

    def _count(self) -> None:
        found = self.chunks.agg(F.sum("n_words").alias("n"), F.max(F.shiftright("chunk", 33)).alias("file"), F.max(F.expr("chunk & 8589934591")).alias("nth")).first()
        ranges = self.ranges = max(1, 4 * (found.n or 0) // (3 * self.most))
        # Chunks are dealt one by one: the first of each file, the second of each, and so on.
        files, nth = (found.file or 0) + 1, (found.nth or 0) + 1
        self.place = F.expr(f"(chunk & 8589934591) * {files} + shiftright(chunk, 33)")
        self.tasks = min(files * nth, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), files * nth // 4))
        buckets, kind = self.buckets, self._kind()

        def send(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    for r, *block in _features(row, ranges).blocks(ranges):
                        yield pa.record_batch([pa.array([r], pa.int32()), pa.array([row["chunk"]]), *(pa.array([b], pa.binary()) for b in block)], ["part", "chunk", "words", "ones", "first", "second", "fan", "third", "counts"])
                    give_back()

        def count(batches):
            rows, part = [], 0
            for batch in batches:
                for part, chunk, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows.append((chunk, block))
            if not rows:
                return
            total, answers = _count_range([block for _, block in rows], buckets)
            for (chunk, _), answer in zip(rows, answers, strict=True):
                yield pa.record_batch([pa.array([ANSWER], pa.int32()), pa.array([chunk]), pa.array([part], pa.int32()), pa.array([_planes(answer, kind)]), pa.nulls(1, pa.list_(pa.int64()))], ["kind", "chunk", "part", "buckets", "total"])
            yield pa.record_batch([pa.array([TOTALS], pa.int32()), pa.array([-1]), pa.array([part], pa.int32()), pa.nulls(1, pa.binary()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["kind", "chunk", "part", "buckets", "total"])
            rows = answers = None
            give_back()

        sent = self.chunks.mapInArrow(send, "part int, chunk long, words binary, ones binary, first binary, second binary, fan binary, third binary, counts binary")
        answers = sent.repartitionById(ranges, F.col("part")).mapInArrow(count, "kind int, chunk long, part int, buckets binary, total array<long>")
        self.answers = self.scratch.table(answers, "answers")
        sums = self.answers.where(F.col("kind") == TOTALS).select(F.posexplode("total").alias("bucket", "n")).groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        self.totals = [0] * buckets
        for row in sums.collect():  # a row a bucket
            self.totals[row.bucket] = int(row.n)

    def _kind(self):
        return np.uint16 if self.buckets <= 1 << 16 else np.uint32

    def weights(self, gains: list[int]) -> DataFrame:
        """id, n_words, n_features, weight of every row."""
        ranges, kind, tasks = self.ranges, self._kind(), self.tasks
        worth = np.array(gains, np.float64)
        chunks = self.chunks.drop("n_words").withColumn("part", F.lit(None).cast("int"))
        answers = self.answers.where(F.col("kind") == ANSWER).select("chunk", "part", "buckets")
        rows = chunks.unionByName(answers, allowMissingColumns=True).withColumn("to", self.place)
        dealt = rows.repartitionById(tasks, F.pmod(F.col("to"), F.lit(tasks)).cast("int")).drop("to").sortWithinPartitions("chunk")

        def meet(batches):
            now, own, found = None, None, []

            def done():
                features = _features(own, ranges)
                number, weight = features.weights(found, worth, kind)
                give_back()
                return pa.record_batch({"id": pa.array(own["ids"], pa.int64()), "n_words": features.lengths, "n_features": number, "weight": weight})

            for batch in batches:
                for row in batch.to_pylist():
                    if row["chunk"] != now:
                        if own is not None:
                            yield done()
                        now, own, found = row["chunk"], None, []
                    if row["part"] is None:
                        own = row
                    else:
                        found.append((row["part"], row["buckets"]))
            if own is not None:
                yield done()

        return dealt.mapInArrow(meet, "id long, n_words long, n_features long, weight long")


# ---------------------------------------------------------------- draws


def bucket_gains(documents: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln) of how much likelier a feature of each bucket is in the target, one added to each count."""
    more, total, wanted = len(documents), sum(documents), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (total + more) / ((s + 1) * (wanted + more)))) for s, t in zip(documents, target, strict=True)]


def resampled(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, seed: str = "42", least_words: int = 20, percent: int = 5, id_col: str = "doc_id", target_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null unless it is drawn.

    Of the documents of at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) with the highest scores are drawn, ties to the smaller id.  Noise comes from the
    id; null ids count as the empty text and come last among ties.  Rows that repeat are ranked one by
    one.  Without documents there are no rows; without a target all counts of it are zero.
    """
    wanted = FeatureCounts(target, buckets=buckets, id_col=target_id, text_col=text_col).totals
    counted = FeatureCounts(docs, buckets=buckets, id_col=id_col, text_col=text_col)
    spark, scratch = counted.spark, counted.scratch
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((chance + 0.5) / F.lit(4294967296.0))))
    weighed = counted.weights(bucket_gains(counted.totals, wanted)).withColumn("score", F.col("weight") + noise)
    scored = scratch.table(weighed, "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    drawn = percent * n // 100

    # Sorted by ranges; a row's rank is its place in its range after the rows of the ranges before.  Rows of equal keys part by their place.
    keys = (F.desc("score"), F.asc_nulls_last("id"), F.asc("at"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANKED_ROWS)
    ordered = scored.where(able).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("at")
    placed = scratch.table(ordered.withColumn("place", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("place", 33).cast("int"))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # a row a task
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row.part, before))
        before += row["count"]
    known = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    rank = F.col("before") + F.expr("place & 8589934591") + 1
    ranked = placed.join(known, "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
