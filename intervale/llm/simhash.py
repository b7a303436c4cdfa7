"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits; two link when they differ in at most ``distance``
bits.  Anchors are the codewords of a covering code: the perfect Golay code of
length 23 and radius 3 on bits 0-22 and again on bits 23-45, and one single
word on the other 18 bits.  Every fingerprint has one home anchor, within the
radius; it is replicated to every anchor within radius plus distance, block by
block.  If two fingerprints link, the second is therefore replicated to the
home of the first, and comparing each anchor's visitors with its residents
finds every link exactly.

Equal fingerprints form one class before any of this.  Anchors without a
resident are known from a bitmap of 2 MB (2**24 anchors, whatever the input)
and get no visitors.  An anchor with more residents than a cap is a grid of
cells: its residents are dealt to rows, its visitors to columns.  A task reads
a cell's residents and then its visitors in blocks, and reports only the
components among the links it finds, not all pairs.

Texts alike by a similarity of their shingles (``without_similar``) start from
these links: fingerprints of 64 bits find the nearest copies, whose shingles
are then compared.  No distance of 64 bits holds all pairs at a similarity of
0.8 and no others, so the pairs beyond come from shared rare shingles, by which
every such pair meets, and are compared in the same way.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.components import components, settle_pairs
from intervale.llm.runtime import Scratch, bit_filter, give_back, new_name, prepare
from intervale.llm.unit_store import as_bytes, parts

SEED = 42
CHUNK = 1 << 16
GOLAY = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, RADIUS = 23, 3
MASK = (1 << LENGTH) - 1
ANCHOR_BITS = 24
#: An anchor with more residents is a grid, of so many rows at most; such anchors are so few that a list of them is bounded.
RESIDENTS, HOT_LIST, MOST_ROWS = 32_768, 100_000, 1024
PAIRS_AT_ONCE = 2_000_000
ROWS_A_TASK, ROWS_AT_ONCE = 1_000_000, 200_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, width: int):
    """Chunks of big-endian XXH64 values of the word shingles, A-Z lower-cased; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    stops = ends[min(width, len(words)) - 1 :][:n] - 1
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), dtype=">u8")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; zero without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += ones_of(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of some big-endian hashes have each bit set, the highest bit first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in texts.to_pylist()], type=pa.int64())

    compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compute, "long")(text.cast("binary"))


# ---------------------------------------------------------------- covering code


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


@lru_cache(maxsize=4)
def _cosets(distance: int) -> list[np.ndarray]:
    """For each excess e of 0..distance: [syndrome, k] differences of a word to the anchors at radius + e.

    Excess 0 also holds the anchors nearer than the radius; -1 fills up.
    """
    found: list[list[list[int]]] = [[[] for _ in range(1 << 11)] for _ in range(distance + 1)]
    for weight in range(RADIUS + distance + 1):
        errors = np.array([sum(1 << p for p in places) for places in itertools.combinations(range(LENGTH), weight)], dtype=np.int64)
        level = found[max(0, weight - RADIUS)]
        for s, e in zip(_syndromes(errors).tolist(), errors.tolist(), strict=True):
            level[s].append(e)
    tables = []
    for level in found:
        table = np.full((1 << 11, max(1, *map(len, level))), -1, dtype=np.int64)
        for s, errors in enumerate(level):
            table[s, : len(errors)] = errors
        tables.append(table)
    return tables


@lru_cache(maxsize=1)
def _halves() -> tuple[np.ndarray, np.ndarray]:
    return _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)


def _syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _halves()
    return low[words & 0xFFF] ^ high[words >> 12]


def _blocks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prints & MASK, (prints >> LENGTH) & MASK


def homes(prints: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint."""
    out = np.zeros(len(prints), dtype=np.int64)
    for word in _blocks(prints):
        nearest = word ^ _cosets(0)[0][_syndrome(word), 0]
        out = out << 12 | nearest >> 11
    return out


def visits(prints: np.ndarray, distance: int, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all anchors within radius plus distance that have a resident by the bitmap."""
    first, second = _blocks(prints)
    tables, index = _cosets(distance), np.arange(len(prints))
    near = [
        [np.where(t[s] < 0, -1, (w[:, None] ^ t[s]) >> 11) for t in tables]
        for w, s in ((first, _syndrome(first)), (second, _syndrome(second)))
    ]
    who, where = [], []
    for a, b in itertools.product(range(distance + 1), repeat=2):
        if a + b > distance:
            continue
        x, y = near[0][a][:, :, None], near[1][b][:, None, :]
        anchor = np.where((x < 0) | (y < 0), -1, x << 12 | y).reshape(len(prints), -1)
        held = (anchor >= 0) & ((resident[anchor >> 3] >> (anchor & 7).astype(np.uint8)) & 1).astype(bool)
        rows, cols = np.nonzero(held)
        who.append(index[rows])
        where.append(anchor[rows, cols])
    return np.concatenate(who), np.concatenate(where)


# ---------------------------------------------------------------- links


def _mix(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).astype(np.int64) & 0x7FFFFFFF


def compare(keys: np.ndarray, prints: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links between each key's residents and visitors."""
    order = np.argsort(keys[home], kind="stable")
    resident_key, resident = keys[home][order], prints[home][order]
    visitor_key, visitor = keys[~home], prints[~home]
    low = np.searchsorted(resident_key, visitor_key, "left")
    count = np.searchsorted(resident_key, visitor_key, "right") - low
    low, visitor, count = low[count > 0], visitor[count > 0], count[count > 0]
    found_u, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held = 0

    def settle() -> None:
        u, v = settle_pairs(np.concatenate(found_u), np.concatenate(found_v))
        found_u[:], found_v[:] = [u], [v]

    cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "right")
    for a, b in itertools.pairwise([*np.unique(cuts).tolist(), len(count)]):
        n = count[a:b]
        if not len(n):
            continue
        place = np.repeat(low[a:b] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        x, y = resident[place], np.repeat(visitor[a:b], n)
        linked = (x < y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
        found_u.append(x[linked])
        found_v.append(y[linked])
        held += int(linked.sum())
        if held > PAIRS_AT_ONCE:
            settle()
            held = 0
    settle()
    return found_u[0], found_v[0]


def linked_classes(classes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(node, root) over the distinct fingerprints of column fp that link with another one."""
    spark = classes.sparkSession

    def home_rows(batches):
        for batch in batches:
            yield pa.record_batch({"anchor": homes(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int32)})

    per = classes.select("fp").mapInArrow(home_rows, "anchor int").groupBy("anchor").agg(F.count("*").alias("n"))
    per = scratch.table(per, "anchors")
    words = per.groupBy(F.shiftright("anchor", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, anchor & 31)")).alias("bits"), F.sum("n").alias("n"), F.max("n").alias("most")
    ).toArrow()  # at most 2**19 rows
    bitmap = np.zeros(1 << (ANCHOR_BITS - 5), dtype="<u4")
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    resident = bitmap.view(np.uint8)
    total = int(words["n"].to_numpy().sum()) if len(words) else 0
    cap = max(RESIDENTS, -(-total // HOT_LIST))
    most = int(words["most"].to_numpy().max()) if len(words) else 0
    hot = {r.anchor: min(MOST_ROWS, -(-r.n // cap)) for r in per.where(F.col("n") > cap).collect()} if most > cap else {}
    shared = spark.sparkContext.broadcast((resident.tobytes(), hot))  # 2 MB and at most HOT_LIST anchors

    def replicate(batches):
        resident = np.frombuffer(shared.value[0], dtype=np.uint8)
        hot = shared.value[1]
        hot_keys = np.array(sorted(hot), dtype=np.int64)
        parts_of = np.array([hot[k] for k in hot_keys.tolist()], dtype=np.int64)

        def parts(anchor: np.ndarray) -> np.ndarray:
            out = np.ones(len(anchor), dtype=np.int64)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, anchor), len(hot_keys) - 1)
                out = np.where(hot_keys[at] == anchor, parts_of[at], out)
            return out

        def cells(anchor, prints, home):
            n = parts(anchor)
            own = np.repeat(_mix(prints if home else ~prints) % n, n)  # a resident's row or a visitor's column
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(n, n)
            cell = own * size + other if home else other * size + own
            return pa.record_batch({"key": np.repeat(anchor, n) << 20 | cell, "fp": np.repeat(prints, n), "home": np.full(len(cell), home)})

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4000):
                prints = every[at : at + 4000]
                yield cells(homes(prints), prints, True)
                who, anchor = visits(prints, distance, resident)
                yield cells(anchor, prints[who], False)

    def meet(batches):
        """Rows come by key, residents before visitors; those of a key that goes on are kept for the next block."""
        kept, held, n = [np.zeros(0, np.int64)] * 2, [], 0

        def block():
            key, prints, home = (np.concatenate(x) for x in zip(*held, strict=True))
            key, prints = np.concatenate((kept[0], key)), np.concatenate((kept[1], prints))
            home = np.concatenate((np.ones(len(kept[0]), bool), home))
            u, v = compare(key, prints, home, distance)
            last = home & (key == key[-1])
            kept[:] = key[last], prints[last]
            return pa.record_batch({"u": u, "v": v})

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)))
                n += b.num_rows
            if n >= ROWS_AT_ONCE:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    occupied = int(np.bitwise_count(bitmap).sum()) / (1 << ANCHOR_BITS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (1 + 70 * occupied)) // ROWS_A_TASK)
    dealt = classes.select("fp").mapInArrow(replicate, "key long, fp long, home boolean").repartition(tasks, "key")
    met = dealt.sortWithinPartitions("key", F.desc("home")).mapInArrow(meet, "u long, v long")
    return components(met, scratch, "linked")


def group_rows(rows: DataFrame, scratch: Scratch, distance: int = 2) -> DataFrame:
    """(id, fp) -> (fp, component): classes that hold several rows or link with another, with the smallest id reachable."""
    classes = scratch.table(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    roots = scratch.table(linked_classes(classes, distance, scratch), "roots")
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n", "least", "root")
    least = labelled.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    linked = labelled.where("root is not null").join(least, "root").select("fp", "component")
    copies = labelled.where("root is null and n > 1").select("fp", F.col("least").alias("component"))
    return linked.unionByName(copies)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    A null or wordless text has fingerprint zero and links like any other.  A
    text of fewer words than the width is one shingle.  Rows that repeat keep a
    row each; a null id is never the smallest unless its component has no other.
    Further columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    rows = scratch.table(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")), "prints")
    groups = group_rows(rows, scratch, distance)
    return rows.join(groups, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 3) -> DataFrame:
    """One row of each group of near duplicates, with the columns of the input: the one with the smallest id.

    Null ids come after all others; rows that repeat an id, the first that landed.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    row, fp = new_name("row", docs.columns), new_name("fp", docs.columns)
    landed = scratch.table(docs.withColumns({row: F.monotonically_increasing_id(), fp: fingerprint_column(F.col(text_col), width)}), "landed")
    rank = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    groups = group_rows(landed.select(F.col(fp).alias("fp"), rank.alias("id")), scratch, distance)
    keepers = groups.select(F.col("fp").alias(fp), F.col("component.row").alias(new_name("keeper", docs.columns)))
    keeper = keepers.columns[1]
    return landed.join(keepers, fp, "left").where(F.col(keeper).isNull() | (F.col(keeper) == F.col(row))).select(*docs.columns)


# ---------------------------------------------------------------- similar shingle sets

#: The order of shingles takes counts from about so many texts, and keeps at most so many of the most common.
SAMPLE_TEXTS, MOST_COMMON = 50_000, 1 << 18
#: Pairs of different components are all compared once they are at most so many an entry (or in all); before that, after
#: at most so many rounds, each key's texts are compared with one of them.
PAIRS_AN_ENTRY, FEW_PAIRS, STAR_ROUNDS = 1, 100_000, 1
#: Classes of shingles whose parities rule out pairs that differ in too many: so many, and for candidates twice as many as
#: a set has shingles, up to the larger number.
PARITIES, MOST_PARITIES = 512, 1 << 20
#: Bytes of shingle sets up to which all pairs of a round are confirmed at once; beyond, a quarter of all sets' bytes.
SET_BYTES_AT_ONCE = 64 << 20
#: Sets that share a shingle, up to which all their pairs are candidates at once.
FEW_SETS = 4
#: A key with more entries is a grid of blocks of about so many, of which any two meet in a cell of their own.
ENTRIES_A_BLOCK = 20_000
#: Entries that a task of the exact pairing is dealt, and that it takes in at once (with up to 64 bytes of parities each).
ENTRIES_A_TASK, ENTRIES_HELD = 500_000, 100_000
PART_BYTES = 4 << 20


def _fold(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (state ^ word) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each UTF-8 text (binary) the 64-bit hashes of its word shingles in order, repeats included; A-Z lower-cased."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    flat, begin = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0  # white space at either end gives empty words
    coded = flat.dictionary_encode()
    distinct = as_bytes(coded.dictionary)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    word = hashes[coded.indices.to_numpy()[real]]
    ends = np.concatenate(([0], np.cumsum(real)))[begin]
    seed = np.full(len(word), SEED, np.uint64)
    whole = seed[: max(0, len(word) - width + 1)]
    for k in range(width):
        whole = _fold(whole, word[k : k + len(whole)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(whole[a : b - width + 1])
        else:  # the whole sequence; nothing without words
            one = seed[a : a + 1]
            for k in range(a, b):
                one = _fold(one, word[k : k + 1])
            out.append(one)
    return out


def set_column(spark: SparkSession, text: Column, width: int, share: Fraction, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """struct<cid, n, fp, keys, odd, wide>: 64 bits of a digest of the shingle set, its size, the SimHash of all shingles, a prefix and parities.

    With the shingles of every set in one order, rare ones first, two sets of
    that Jaccard similarity share one of the first n - ceil(share * n) + 1,
    which are the prefix.  ``odd`` has a bit for each of PARITIES classes of
    shingles, set if the set has an odd number of them: two sets differ in as
    many shingles as bits at least.  ``wide`` has the same of more classes, the
    longer the set: a power of two, so that its parts fold to fewer classes.
    All zero and empty without words.
    """
    shared = spark.sparkContext.broadcast(common)  # at most MOST_COMMON

    def one(shingles: np.ndarray) -> tuple[int, int, int, bytes, bytes, bytes]:
        if not len(shingles):
            return 0, 0, 0, b"", bytes(PARITIES // 8), bytes(PARITIES // 8)
        hashes, counts = shared.value
        s = np.unique(shingles)
        cid = int.from_bytes(xxhash.xxh3_64_digest(s.tobytes(), SEED), "big", signed=True)
        ones = sum(ones_of(shingles[at : at + CHUNK].astype(">u8")).astype(np.int64) for at in range(0, len(shingles), CHUNK))
        fp = int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)
        weight = np.zeros(len(s), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
            weight = np.where(hashes[at] == s, counts[at], 0)
        length = len(s) - -(-share.numerator * len(s) // share.denominator) + 1
        classes = max(PARITIES, min(MOST_PARITIES, 1 << (2 * len(s) - 1).bit_length()))
        wide = np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) % classes, minlength=classes) & 1).astype(bool))
        odd = np.bitwise_xor.reduce(wide.reshape(-1, PARITIES // 8), axis=0)
        return cid, len(s), fp, s[np.lexsort((s, weight))[:length]].tobytes(), odd.tobytes(), wide.tobytes()

    def compute(texts: pa.Array) -> pa.Array:
        rows = [one(x) for part in parts(texts.fill_null(b""), PART_BYTES) for x in shingles_of(part, width)]
        give_back()
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cid", "n", "fp", "keys", "odd", "wide"])

    compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(compute, "cid long, n long, fp long, keys binary, odd binary, wide binary")(text.cast("binary"))


def common_shingles(docs: DataFrame, scratch: Scratch, *, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the most common shingles of a sample; they only order what is compared exactly."""

    def hashes(batches):
        for batch in batches:
            for part in parts(batch.column(0), PART_BYTES):
                for s in shingles_of(part, width):
                    yield pa.record_batch({"h": np.unique(s).view(np.int64)})
            give_back()

    place = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40))
    some = docs.where(F.col(text_col).isNotNull() & (place <= min(1 << 40, (SAMPLE_TEXTS << 40) // max(1, docs.count())))).select(F.col(text_col).cast("binary"))
    counts = scratch.table(some.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2"), "common")
    least, held = 1 << 62, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():  # one row a count, of a bounded sample
        held += r.k
        if held > MOST_COMMON:
            break
        least = r.c
    got = counts.where(F.col("c") >= least).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _may_be_similar(share: Fraction, n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and places allow it: at the first shingle two sets share, no more can follow than is left of either."""
    p, q = share.numerator, share.denominator
    left = 1 + np.minimum(n[x] - pos[x] - 1, n[y] - pos[y] - 1)
    return (left * (p + q) >= p * (n[x] + n[y])) & (np.minimum(n[x], n[y]) * q >= p * np.maximum(n[x], n[y]))


def shared_prefixes(sets: DataFrame, entries: int, common: tuple[np.ndarray, np.ndarray], share: Fraction) -> DataFrame:
    """(cid, n, keys) -> (key, cid, n, pos, other) of the shingles of prefixes that two or more sets share.

    A shingle that few sets share gives their pairs (cid, other); any other one
    gives its entries, without another.  Entries of a common shingle are dealt
    out by set as well, and all stay.  ``entries`` is how many there are, by which
    they are dealt to tasks.
    """
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // ROWS_A_TASK)
    shared = spark.sparkContext.broadcast(common[0])  # at most MOST_COMMON
    kind = np.dtype([("key", "<u8"), ("cid", "<i8"), ("n", "<i4"), ("pos", "<i4")])

    def is_common(keys: np.ndarray) -> np.ndarray:
        hashes = shared.value
        return hashes[np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)] == keys if len(hashes) else np.zeros(len(keys), bool)

    def prefixes(batches):
        for batch in batches:
            found, seen = [np.empty(0, kind)], set()
            for cid, n, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid in seen:
                    continue
                seen.add(cid)
                keys = np.frombuffer(keys, "<u8")
                entry = np.empty(len(keys), kind)
                entry["key"], entry["cid"], entry["n"], entry["pos"] = keys, cid, n, np.arange(len(keys))
                found.append(entry)
            entries = np.concatenate(found)
            salt = np.where(is_common(entries["key"]), _mix(entries["cid"]), 0)
            part = _mix(entries["key"].view(np.int64) ^ salt) % tasks
            order = np.argsort(part, kind="stable")
            entries, (parts, starts) = entries[order], np.unique(part[order], return_index=True)
            spans = itertools.pairwise([*starts.tolist(), len(entries)])
            yield pa.record_batch({"part": parts.astype(np.int32), "entries": pa.array([entries[a:b].tobytes() for a, b in spans], pa.binary())})
        give_back()

    def meet(batches):
        got = [np.frombuffer(x, kind) for b in batches for x in b.column(1).to_pylist()]
        if not got:
            return
        entries = np.concatenate(got)
        got.clear()
        entries = entries[np.lexsort((entries["cid"], entries["key"]))]
        key, cid = entries["key"], entries["cid"]
        entries = entries[np.concatenate(([True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])))]  # each set once a key
        key, cid, n, pos = (np.ascontiguousarray(entries[c]).astype(np.int64) for c in ("key", "cid", "n", "pos"))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.repeat(np.diff([*starts.tolist(), len(key)]), np.diff([*starts.tolist(), len(key)]))
        dealt_out = is_common(entries["key"])
        few, pairs = (size > 1) & (size <= FEW_SETS) & ~dealt_out, [np.empty((0, 2), np.int64)]
        for step in range(1, FEW_SETS):
            x = np.flatnonzero(few[:-step] & (key[step:] == key[:-step]))
            x = x[_may_be_similar(share, n, pos, x, x + step)]
            pairs.append(np.column_stack((np.minimum(cid[x], cid[x + step]), np.maximum(cid[x], cid[x + step]))))
        found = np.unique(np.concatenate(pairs), axis=0)
        for at in range(0, len(found), 100_000):
            x = found[at : at + 100_000]
            yield pa.record_batch([pa.nulls(len(x), pa.int64()), pa.array(x[:, 0].copy()), *[pa.nulls(len(x), pa.int64())] * 2, pa.array(x[:, 1].copy())], ["key", "cid", "n", "pos", "other"])
        many = np.flatnonzero((size > FEW_SETS) | dealt_out)
        for at in range(0, len(many), 100_000):
            x = many[at : at + 100_000]
            yield pa.record_batch([pa.array(key[x]), pa.array(cid[x]), pa.array(n[x]), pa.array(pos[x]), pa.nulls(len(x), pa.int64())], ["key", "cid", "n", "pos", "other"])
        give_back()

    dealt = sets.select("cid", "n", "keys").mapInArrow(prefixes, "part int, entries binary").repartitionById(tasks, F.col("part"))
    return dealt.mapInArrow(meet, "key long, cid long, n long, pos long, other long")


def candidate_pairs(entries: DataFrame, hot: DataFrame, share: Fraction, turn: int | None, total: int) -> DataFrame:
    """(u, v) of entries (key, cid, n, pos, root) of one key and different roots that may be similar.

    With a turn, each key's entries are paired with one of them: at first the one
    in which the fewest rarer shingles come before the key, since of copies with
    changes the least changed one is similar to most, then others; without, all with all, and entries have parities (odd).  A key of ``hot`` (key, blocks) is dealt to
    blocks: with a turn each is on its own, without every two meet.  Only pairs
    that sizes, places or parities rule out are left out: sets of that similarity
    differ in at most (1 - share) / (1 + share) of their sizes' sum.  ``total`` is
    the number of entries, by which they are dealt to tasks; a task gets its keys
    in order and holds the entries of a few at a time, at most those of two blocks of one.
    """
    spark, most_held = entries.sparkSession, ENTRIES_HELD

    def pair(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high = (batch.column(i).to_numpy() for i in (0, 5, 6))
            if sum(b.num_rows for b in held) >= most_held:
                # The last key's entries may go on in the next batch.
                cut = int(np.flatnonzero((key != key[-1]) | (low != low[-1]) | (high != high[-1])).max(initial=-1)) + 1
                before = held[-1]
                if cut:
                    yield from pairs_of([*held, batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                    continue
                if any(before.column(i)[-1].as_py() != x[0] for i, x in ((0, key), (5, low), (6, high))):
                    yield from pairs_of(held)
                    held = []
            held.append(batch)
        if held:
            yield from pairs_of(held)
        give_back()

    def pairs_of(batches):
        """Pairs of whole keys."""
        words = lambda c, rows: np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(rows, -1) if turn is None else np.zeros((rows, 0), "<u8")
        got = [[c.to_numpy() for c in b.columns[:8]] + [words(b.columns[-1], b.num_rows)] for b in batches]
        *numbers, odd = (np.concatenate(x) for x in zip(*got, strict=True))
        key, cid, n, pos, root, low, high, block = (x.astype(np.int64) for x in numbers)
        order = np.lexsort((_mix(cid + (turn or 0)), pos if turn == 0 else block, block, high, low, key))
        key, cid, n, pos, root, low, high, block, odd = (x[order] for x in (key, cid, n, pos, root, low, high, block, odd))
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        sizes = np.diff([*starts.tolist(), len(key)])
        first = np.repeat(starts, sizes)
        # Each entry comes after ``count`` entries of its key that it meets: all before it, or all of the other block.
        count = np.arange(len(key)) - first
        lower = np.repeat(np.add.reduceat((block == low).astype(np.int64), starts), sizes)
        count = np.where(low == high, count, np.where(block == high, lower, 0))
        if turn is not None:
            count = np.minimum(count, 1)
        held = np.empty((0, 2), np.int64)
        cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "right")
        for a, b in itertools.pairwise([*np.unique([0, *cuts.tolist()]).tolist(), len(count)]):
            c = count[a:b]
            y = np.repeat(np.arange(a, b), c)
            x = np.repeat(first[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            fits = (root[x] != root[y]) & _may_be_similar(share, n, pos, x, y)
            x, y = x[fits], y[fits]
            near = [np.bitwise_count(odd[x[i : i + CHUNK]] ^ odd[y[i : i + CHUNK]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), CHUNK)]
            fits = np.concatenate([*near, np.zeros(0, np.int64)]) * (share.denominator + share.numerator) <= (n[x] + n[y]) * (share.denominator - share.numerator)
            x, y = cid[x[fits]], cid[y[fits]]
            held = np.unique(np.concatenate((held, np.column_stack((np.minimum(x, y), np.maximum(x, y))))), axis=0)
            if len(held) > PAIRS_AT_ONCE:
                yield pa.record_batch({"u": np.ascontiguousarray(held[:, 0]), "v": np.ascontiguousarray(held[:, 1])})
                held = held[:0]
        yield pa.record_batch({"u": np.ascontiguousarray(held[:, 0]), "v": np.ascontiguousarray(held[:, 1])})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ENTRIES_A_TASK)
    dealt = entries.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    others = F.array("block") if turn is not None else F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select("key", "cid", "n", "pos", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *(["odd"] if turn is None else []))
    return dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(pair, "u long, v long").distinct()


def plausible(pairs: DataFrame, classes: DataFrame, share: Fraction) -> DataFrame:
    """(u, v, size) of the pairs that sizes and wide parities of (cid, size, wide) allow, with the sum of both sizes.

    Parities are a fraction of the bytes of a set, so that few pairs are left for which sets have to move.
    """
    p, q = share.numerator, share.denominator

    def check(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 4))
            near = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                few, many = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                near[i] = np.bitwise_count(few ^ np.bitwise_xor.reduce(many.reshape(-1, len(few)), axis=0)).sum()
            fits = pa.array((near * (q + p) <= (n + m) * (q - p)) & (np.minimum(n, m) * q >= p * np.maximum(n, m)))
            yield pa.record_batch({"u": batch.column(0).filter(fits), "v": batch.column(1).filter(fits), "size": pa.array(n + m).filter(fits)})

    u, v = classes.select(F.col("cid").alias("u"), F.col("size").alias("n"), F.col("wide").alias("x")), classes.select(F.col("cid").alias("v"), F.col("size").alias("m"), F.col("wide").alias("y"))
    both = pairs.join(v.hint("merge"), "v").join(u.hint("merge"), "u").select("u", "v", "n", "x", "m", "y")
    return both.mapInArrow(check, "u long, v long, size long")


def confirmed(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The pairs whose shingle sets (cid, shingles) have that Jaccard similarity or more."""
    p, q = share.numerator, share.denominator

    def check(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                near.append(common * q >= p * (len(both) - common))
            near = pa.array(near, pa.bool_())
            yield pa.record_batch({"u": batch.column(0).filter(near), "v": batch.column(1).filter(near)})
        give_back()

    u, v = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("cid").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(v.hint("merge"), "v").join(u.hint("merge"), "u").select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def sets_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(text, row, cid) -> (cid, shingles) of the wanted rows (keeper): one of each cid, not its copies that a filter takes for it."""

    def shingles(batches):
        for batch in batches:
            at = 0
            for part in parts(batch.column(1).fill_null(b""), PART_BYTES):
                sets = [np.unique(s).tobytes() for s in shingles_of(part, width)]
                yield pa.record_batch({"cid": batch.column(0).slice(at, len(part)), "shingles": pa.array(sets, pa.binary()), "keeper": batch.column(2).slice(at, len(part))})
                at += len(part)
            give_back()

    some = rows.where(bit_filter(wanted)(F.col("row")))
    found = some.select("cid", F.col("text").cast("binary"), "row").mapInArrow(shingles, "cid long, shingles binary, keeper long")
    return found.join(wanted, "keeper", "left_semi").select("cid", "shingles")


def near_prints(classes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(u, v): each class of texts (cid, fp) with one of those whose fingerprints are near by the covering code."""
    roots = linked_classes(classes.select("fp").distinct(), distance, scratch)
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("cid", F.coalesce("root", "fp").alias("g"))
    firsts = grouped.groupBy("g").agg(F.min("cid").alias("first"), F.count("*").alias("c")).where("c > 1").select("g", "first")
    return grouped.join(firsts, "g").where("cid <> first").select(F.least("cid", "first").alias("u"), F.greatest("cid", "first").alias("v"))


def similar_roots(entries: DataFrame, near: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], scratch: Scratch, share: Fraction) -> DataFrame:
    """(node, root) of the sets that link with another.  ``sets`` gives those of (cid), ``classes`` their sizes and parities (cid, size, odd, wide).

    Pairs that parities allow are confirmed in as many parts as hold a bounded
    share of all sets each.  First the pairs ``near`` (u, v) and those of shingles that few sets share are
    compared, then the entries of all other shingles.  Texts of one component
    need no comparison.  So each key's are first compared with one of them, which
    joins large groups by few pairs, until the pairs left over are few; these are
    then all compared.
    """
    links, roots, done = None, None, None
    most = max(SET_BYTES_AT_ONCE, 2 * (classes.agg(F.sum("size")).first()[0] or 0))  # 8 bytes a shingle

    def compare_pairs(pairs: DataFrame, name: str) -> None:
        nonlocal links, roots, done
        pairs = scratch.table(plausible(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), classes, share), f"pairs-{name}")
        done = pairs.select("u", "v") if done is None else done.unionByName(pairs.select("u", "v"))
        turns = -(-8 * (pairs.agg(F.sum("size")).first()[0] or 0) // most)
        for turn in range(max(1, turns)):
            part = pairs.select("u", "v").where(F.pmod(F.xxhash64("u", "v"), F.lit(max(1, turns))) == turn)
            ends = part.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
            held = scratch.table(sets(ends), f"sets-{name}-{turn}")
            found = scratch.table(confirmed(part, held, share), f"links-{name}-{turn}")
            scratch.free(f"sets-{name}-{turn}")
            links = found if links is None else links.unionByName(found)
        roots = scratch.table(components(links, scratch, f"similar-{name}"), f"roots-{name}")

    few = entries.where("other is not null").select(F.col("cid").alias("u"), F.col("other").alias("v"))
    compare_pairs(near.unionByName(few).distinct(), "few")
    entries = entries.where("other is null").drop("other")
    total = entries.count()
    if not total:
        return roots
    hot = entries.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > ENTRIES_A_BLOCK).select("key", F.ceil(F.col("c") / ENTRIES_A_BLOCK).alias("blocks"))
    hot = scratch.table(hot, "hot")
    for turn in range(STAR_ROUNDS + 1):
        labels = roots.select(F.col("node").alias("cid"), F.col("root").alias("to"))
        now = scratch.table(entries.join(labels, "cid", "left").select("key", "cid", "n", "pos", F.coalesce("to", "cid").alias("root")), f"entries-{turn}")
        if turn:
            scratch.free(f"entries-{turn - 1}")
        alike = now.groupBy("key", "root").agg(F.count("*").alias("c"))
        left = alike.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
        if not left:
            break
        last = left <= max(FEW_PAIRS, PAIRS_AN_ENTRY * total) or turn == STAR_ROUNDS
        if last:  # only entries of keys that still have different roots can pair
            mixed = alike.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1").select("key")
            now = now.join(mixed, "key", "left_semi").join(classes.select("cid", "odd"), "cid")
        compare_pairs(candidate_pairs(now, hot, share, None if last else turn, total), str(turn))
        if last:
            break
    return roots


def without_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 3, label: str = "similar"
) -> DataFrame:
    """One row of each group of texts whose word shingles are alike, with the columns of the input.

    Groups are components of all pairs whose sets of shingles have that Jaccard
    similarity or more; fingerprints within ``distance`` bits are compared first.
    Of a group the smallest id stays; null ids come after all others; rows that
    repeat an id, the first that landed.  Null, empty and wordless texts are one
    group.  An empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    scratch, share = Scratch(spark, label), Fraction(similarity).limit_denominator(10_000)
    row, mark = new_name("row", docs.columns), new_name("set", docs.columns)
    common = common_shingles(docs, scratch, text_col=text_col, width=width)
    landed = scratch.table(docs.withColumns({row: F.monotonically_increasing_id(), mark: set_column(spark, F.col(text_col), width, share, common)}), "landed")
    rank = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    marked = landed.select(*[F.col(f"{mark}.{c}").alias(c) for c in ("cid", "fp", "odd", "wide")], F.col(f"{mark}.n").alias("size"), rank.alias("rank"))
    classes = scratch.table(marked.groupBy("cid").agg(F.min("rank").alias("least"), F.min("fp").alias("fp"), F.first("odd").alias("odd"), F.first("wide").alias("wide"), F.first("size").alias("size"), F.count("*").alias("n")), "classes")
    rows = landed.select(F.col(text_col).alias("text"), F.col(row).alias("row"), F.col(f"{mark}.cid").alias("cid"))

    def sets(ends: DataFrame) -> DataFrame:
        return sets_of(rows, ends.join(classes, "cid").select(F.col("least.row").alias("keeper")), width)

    near = near_prints(classes, distance, scratch)
    prefixes = landed.agg(F.sum(F.octet_length(F.col(f"{mark}.keys")) / 8).cast("long").alias("n")).first().n or 0
    entries = scratch.table(shared_prefixes(landed.select(f"{mark}.*"), prefixes, common, share), "entries")
    roots = similar_roots(entries, near, classes, sets, scratch, share)
    labelled = classes.join(roots, classes.cid == roots.node, "left").select("cid", "n", "least", F.coalesce("root", "cid").alias("root"))
    keepers = labelled.groupBy("root").agg(F.min("least").alias("keeper"), F.sum("n").alias("rows")).where("rows > 1").select("root", F.col("keeper.row").alias("keeper"))
    by_set = labelled.select("cid", "root").join(keepers, "root").select("cid", "keeper")
    lost = scratch.table(rows.select("cid", "row").join(by_set, "cid").where("row <> keeper").select("row"), "lost")
    scratch.free("entries")
    may_go = bit_filter(lost)(F.col(row))  # the texts of all other rows aren't shuffled
    stay = landed.where(may_go).join(lost.select(F.col("row").alias(row)), row, "left_anti")
    return landed.where(~may_go).select(*docs.columns).unionByName(stay.select(*docs.columns))
