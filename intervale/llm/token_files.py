"""Token-id files: documents tokenised, ordered by id, and written as rANS blocks.

A set of files is a folder of two Parquet tables: ``frequencies`` (one row an
id) and ``blocks``, whose rows are independent blocks of whole documents in
ascending id order.  Parquet is the container only, so that Spark's committer
makes the files whole whichever executors are lost and any store can hold them;
ids are in the blocks' own coding (see ``rans``).

Tokenising cuts a text at ASCII white space where the vocabulary's own rules
show that a text's ids are its words' ids; the words of a batch are
dictionary-encoded, each distinct one is looked up once and the library sees
only new ones.  Any other vocabulary gets whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.rans import Block, Coder, Frequencies
from intervale.llm.runtime import Scratch, give_back, prepare
from intervale.llm.unit_store import UnitStore, as_bytes, parts

BLOCK_TOKENS, LANES = 1 << 18, 1024
REMEMBERED_WORDS, REMEMBERED_BYTES = 400_000, 64
PART_BYTES = 4 << 20
WORDS_A_CALL = 1000
DOCS_A_BUCKET = 100_000
SPECIAL, MARK = "<|", b"\x01"
# The rules of vocabularies that lower-case, drop white space and never join words across it.
SPACELESS_NORMALIZERS = (
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
)
SPACELESS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_spaces(tokenizer_json: str) -> bool:
    """Whether a text's ids are the ids of its words, A-Z lower-cased, one after another."""
    spec = json.loads(tokenizer_json)
    steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer")]
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split, rest = cutters[0], cutters[1:]
    return (
        all(step in SPACELESS_NORMALIZERS for step in steps) and {"type": "Lowercase"} in steps
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": SPACELESS_SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in rest)
        and spec.get("post_processor") is None and all(t["content"].startswith(SPECIAL) for t in spec.get("added_tokens", []))
    )


def _apart(texts: pa.Array) -> pa.Array:
    """The texts with a space before each full stop or comma that ends a word after a letter a-z: such a sign is a piece of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(data) < 2:
        return texts
    last = np.zeros(len(data) + 1, bool)  # a word ends before this byte
    last[:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    last[ends] = True
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    sign = (data[1:] == 46) | (data[1:] == 44)
    at = 1 + np.flatnonzero(sign & (data[:-1] >= 97) & (data[:-1] <= 122) & last[2:] & ~first[1:-1])
    if not len(at):
        return texts
    spaced = np.insert(data, at, 32)
    moved = (ends + np.searchsorted(at, ends, "left")).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(moved), pa.py_buffer(spaced)])


class WordTokenizer:
    """Ids of whole texts, equal to the library's, with an end id after each text."""

    def __init__(self, tokenizer_json: str, end_id: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # words are remembered here
        self.size = max(end_id + 1, self.library.get_vocab_size(with_added_tokens=True))
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.by_words, self.end = cuts_at_spaces(tokenizer_json), np.array([end_id], self.kind)
        self.store = UnitStore(self.kind, most_units=REMEMBERED_WORDS, most_bytes=REMEMBERED_BYTES)
        if self.by_words:
            suffix = self.library.model.end_of_word_suffix or ""
            self.is_last = np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
            self.mark = self._whole([MARK])[0][-1]
            self.by_words = bool(suffix) and len(self._whole([MARK])[0]) == 1

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def _words(self, words: list[bytes], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words, many in one text.

        A word of nothing but letters is one piece of that text, whose last id
        ends a piece; other words stand between marks that no word holds.
        """
        ids, lengths = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        calls = [words[i : i + WORDS_A_CALL] for i in range(0, len(words), WORDS_A_CALL)]
        between = b" " if letters else b" " + MARK + b" "
        for call, found in zip(calls, self._whole([between.join(c) + (b"" if letters else between) for c in calls]), strict=True):
            last = np.flatnonzero(self.is_last[found] if letters else found == self.mark)
            if len(last) == len(call):
                count = np.diff(last, prepend=-1)
                if not letters:
                    found, count = np.delete(found, last), count - 1
            else:  # not as the rules say
                apart = self._whole(call)
                found, count = np.concatenate(apart), np.array([len(x) for x in apart])
            ids.append(found)
            lengths.append(count)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Slots of new words."""
        out = np.empty(len(words), np.int64)
        marked = np.zeros(len(words), bool)
        if MARK in b" ".join(words):
            marked = np.array([MARK in w for w in words])
        try:
            letters = pc.utf8_is_alpha(pa.array(words, pa.binary()).view(pa.string())).to_numpy(zero_copy_only=False).astype(bool)
        except pa.ArrowInvalid:  # some text isn't UTF-8
            letters = np.zeros(len(words), bool)
        for kind in (letters, ~letters & ~marked):
            places = np.flatnonzero(kind)
            if len(places):
                out[places] = self.store.add(*self._words([words[i] for i in places.tolist()], kind is letters))
        places = np.flatnonzero(marked)
        if len(places):
            found = self._whole([words[i] for i in places.tolist()])
            out[places] = self.store.add(np.concatenate(found), np.array([len(x) for x in found]))
        return out

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), the end ids included."""
        low = pc.ascii_lower(texts.view(pa.string()))  # A-Z and nothing else, byte by byte
        whole = np.flatnonzero(pc.match_substring(low, SPECIAL).to_numpy(zero_copy_only=False))
        if len(whole):
            low = pc.if_else(pc.match_substring(low, SPECIAL), "", low)
        words = pc.ascii_split_whitespace(_apart(low))
        coded = words.flatten().dictionary_encode()
        store = self.store
        slots = store.slots(as_bytes(coded.dictionary), self._learn)[coded.indices.to_numpy()]
        begin = words.offsets.to_numpy().astype(np.int64)
        if len(whole):
            found = self._whole([texts[i].as_py() for i in whole.tolist()])
            slots[begin[whole]] = store.add(np.concatenate(found), np.array([len(x) for x in found]))
        slots = np.insert(slots, begin[1:], store.add(self.end, np.array([1]))[0])
        lengths = store.lengths(slots)
        ends = np.cumsum(lengths)[begin[1:] + np.arange(len(texts))]
        return store.gather(slots, lengths), np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts (binary; null counts as empty) one after another, and the number of each text's."""
        texts = texts.fill_null(b"")
        if not self.by_words:
            found = [np.concatenate((x, self.end)) for x in self._whole(texts.to_pylist())]
            return np.concatenate(found or [np.zeros(0, self.kind)]), np.array([len(x) for x in found], np.int64)
        ids, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for part in parts(texts, PART_BYTES):
            self.store.tidy()
            found, n = self._part(part)
            ids.append(found)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(maxsize=1)
def _tokenizer(tokenizer_json: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(tokenizer_json, end_id)


def tokenise(docs: DataFrame, tokenizer_path: str, scratch: Scratch, *, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(seq, doc_id, ids, counts) in a table: seq ascends with doc_id over all of it, null ids first.

    Rows with ``counts`` are no documents: each task adds one, with the number
    of times it has met each id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n = rows.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // DOCS_A_BUCKET)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("cuts")).first().cuts or []
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((f.read(), np.unique(np.array(cuts[: buckets - 1], dtype=np.int64))))  # the vocabulary and a number a bucket

    def encode(batches):
        json, cuts = shared.value
        tokenizer = _tokenizer(json, end_id)
        total = np.zeros(tokenizer.size, np.int64)
        for batch in batches:
            ids, n = tokenizer.encode(batch.column(1))
            total += np.bincount(ids, minlength=len(total))
            ends = np.concatenate(([0], np.cumsum(n) * ids.itemsize)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
            known = batch.column(0)
            bucket = np.where(known.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, known.fill_null(0).to_numpy(zero_copy_only=False), "left"))
            yield pa.record_batch({"bucket": bucket.astype(np.int32), "doc_id": known, "ids": packed, "counts": pa.nulls(len(n), pa.binary())})
            give_back()
        if total.any():
            met = zlib.compress(total.astype("<i8").tobytes(), 1)
            yield pa.record_batch({"bucket": np.array([zlib.crc32(met) % buckets], np.int32), "doc_id": pa.nulls(1, pa.int64()), "ids": [b""], "counts": [met]})

    encoded = rows.mapInArrow(encode, "bucket int, doc_id long, ids binary, counts binary").repartitionById(buckets, F.col("bucket"))
    ordered = encoded.sortWithinPartitions(F.col("counts").isNull(), "doc_id", "ids")
    return scratch.table(ordered.select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids", "counts"), "ids")


def _kind(tokenizer_path: str, end_id: int) -> np.dtype:
    with open(tokenizer_path, encoding="utf-8") as f:
        return WordTokenizer(f.read(), end_id).kind


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Tokenise documents, append ``end_id`` to each and write the files.

    Null texts count as empty; rows that repeat an id are ordered by their ids
    of tokens, null ids come first; further columns are ignored; an empty table
    gives files without blocks.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "tokens")
    table = tokenise(docs, tokenizer_path, scratch, id_col=id_col, text_col=text_col, end_id=end_id)
    kind = _kind(tokenizer_path, end_id)

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for met in batch.column(0).to_pylist():
                seen = np.frombuffer(zlib.decompress(met), "<i8")
                total = seen.copy() if not len(total) else total + seen
        ids = np.flatnonzero(total)
        yield pa.record_batch({"id": ids.astype(np.int64), "n": total[ids]})

    met = table.where("counts is not null").select("counts")
    found = met.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row an id of the vocabulary
    table_of = Frequencies.scale(found["id"].to_numpy(), found["n"].to_numpy())
    rows = list(zip(table_of.ids.tolist(), table_of.counts.tolist(), strict=True))
    spark.createDataFrame(rows, "id long, count long").withColumn("bits", F.lit(table_of.bits)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(table_of)

    def encode(batches):
        coder = Coder(shared.value)
        ids, docs, seq, held = [], [], [], 0

        def flush():
            block = coder.encode(np.frombuffer(b"".join(ids), dtype=kind), LANES)
            lengths = [len(x) // kind.itemsize for x in ids]
            return pa.RecordBatch.from_pylist(
                [{"seq": seq[0], "doc_ids": list(docs), "lengths": lengths} | block.__dict__], schema=schema
            )

        for batch in batches:
            for s, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq and (s != seq[-1] + 1 or held >= BLOCK_TOKENS):
                    yield flush()
                    ids, docs, seq, held = [], [], [], 0
                ids.append(x)
                docs.append(d)
                seq.append(s)
                held += len(x) // kind.itemsize
        if seq:
            yield flush()

    fields = {"seq": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "n": pa.int64(), "lanes": pa.int32(), "states": pa.binary(), "words": pa.binary(), "checkpoints": pa.binary(), "words_crc32": pa.int64(), "ids_crc32": pa.int64()}
    schema = pa.schema(fields)
    kinds = "seq long, doc_ids array<long>, lengths array<long>, n long, lanes int, states binary, words binary, checkpoints binary, words_crc32 long, ids_crc32 long"
    documents = table.where("counts is null").select("seq", "doc_id", "ids")
    documents.mapInArrow(encode, kinds).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    scratch.free("ids")


def _read(spark: SparkSession, folder: str, emit, kinds: str) -> DataFrame:
    """mapInArrow over the blocks; emit(seq, doc_ids, lengths, ids) gives a block's record batch."""
    found = spark.read.parquet(f"{folder}/frequencies").orderBy("id").toArrow()
    bits = found["bits"][0].as_py() if len(found) else 12
    shared = spark.sparkContext.broadcast(Frequencies(found["id"].to_numpy(), found["count"].to_numpy(), bits))

    def decode(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                seq, docs, lengths = row.pop("seq"), row.pop("doc_ids"), row.pop("lengths")
                yield emit(seq, docs, lengths, coder.decode(Block(**row)))

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(decode, kinds)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of the documents in the files."""

    def emit(seq, docs, lengths, ids):
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))})

    return _read(spark, folder, emit, "doc_id long, ids array<long>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def emit(seq, docs, lengths, ids):
        ends = np.cumsum(lengths)
        raw = ids.tobytes()
        sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
        n = len(docs)
        return pa.record_batch({"seq": np.full(n, seq), "doc_id": pa.array(docs, pa.int64()), "before": ends - np.array(lengths), "n_tokens": np.array(lengths), "ids_crc32": np.array(sums, dtype=np.int64)})

    index = spark.read.parquet(f"{folder}/blocks").select("seq", "n", F.shiftright("seq", 33).alias("bucket"))
    of_bucket = index.groupBy("bucket").agg(F.sum("n").alias("n"))  # a row a bucket
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = of_bucket.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(of_bucket, "bucket").select("seq", (F.col("inside") + F.col("bucket_start")).alias("block_start"))
    rows = _read(spark, folder, emit, "seq long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "seq").select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
