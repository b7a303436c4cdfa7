"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces with log scores come from a SentencePiece model file.  A text gets the
dummy prefix and its spaces become the mark U+2581; the best path over the
pieces is found by Viterbi, walking a double-array trie of their UTF-8 bytes; a
character that no piece covers becomes byte pieces.  Decoding joins pieces,
turns marks back into spaces and byte pieces into bytes, and drops the dummy
prefix, so that it restores every text without a mark of its own exactly.

A model file of byte-pair merges scores its pieces by whole numbers, which are
ranks and no logarithms; its pieces then score by Zipf's law over their order,
``-log(rank + 2)`` less the log of the sum, which is a log probability
over the vocabulary.

No piece of a usable model has a mark after another character, so the best path
of a text is made of the best paths of its units, spaces and what follows them
up to the next space or line end.  The units of a batch are dictionary-encoded;
the new ones among them go through Viterbi side by side, a byte at a time, and
each worker remembers those it has met, up to a bound.
"""

from __future__ import annotations

import math
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import give_back, prepare
from intervale.llm.unit_store import UnitStore, as_bytes, parts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED_UNITS, REMEMBERED_BYTES = 200_000, 80
PART_BYTES, CELLS_AT_ONCE = 4 << 20, 1 << 20
#: Units that no more than so many others are as long as are encoded one by one, by the matches of so many places at once.
SIDE_BY_SIDE, STARTS_AT_ONCE = 128, 1 << 16


# ---------------------------------------------------------------- trie


@dataclass(frozen=True)
class DoubleArray:
    """state s moves by byte b to base[s] + b + 1 if check there is s; value >= 0 marks the end of a key."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in sorted(keys.items()):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = value
        room = 2 * len(children) + 1024
        base, check, value = [0] * room, [-1] * room, [-1] * room
        slot = [0] * len(children)
        check[0], value[0] = 0, ends[0]
        from_slot: dict[int, int] = {}  # where to look on for nodes of so many children
        for node, moves in enumerate(children):  # a child is numbered after its parent
            if not moves:
                continue
            codes = sorted(moves)
            at = max(from_slot.get(len(codes), 1), codes[0] + 1)
            while True:
                start = at - codes[0] - 1
                if start + 257 >= len(check):
                    base += [0] * room
                    check += [-1] * room
                    value += [-1] * room
                if check[at] < 0 and all(check[start + c + 1] < 0 for c in codes):
                    break
                at += 1
            base[slot[node]] = start
            from_slot[len(codes)] = at
            for c in codes:
                child = moves[c]
                slot[child] = start + c + 1
                check[slot[child]], value[slot[child]] = slot[node], ends[child]
        size = max(i for i, c in enumerate(check) if c >= 0) + 258
        return DoubleArray(*(np.array((x + [y] * size)[:size], dtype=np.int32) for x, y in ((base, 0), (check, -1), (value, -1))))


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: text and log score of each id, the ids of the byte pieces, and the trie of the others."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    trie: DoubleArray
    unknown: int

    @staticmethod
    def of(names: list[str], scores: list[float], byte_ids: list[int], normal: list[int], unknown: int = 0) -> Pieces:
        for i in normal:
            if MARK in names[i].lstrip(MARK) or "\n" in names[i]:
                raise ValueError(f"piece {names[i]!r} spans units")
        given = [scores[i] for i in normal]
        full = [0.0] * len(names)
        if len(given) > 1 and all(x == int(x) for x in given):
            log_sum = math.log(sum(1 / (r + 2) for r in range(len(normal))))
            given = [-math.log(r + 2) - log_sum for r in range(len(normal))]
        for i, s in zip(normal, given, strict=True):
            full[i] = s
        return Pieces(tuple(names), tuple(full), tuple(byte_ids), DoubleArray.build({names[i].encode(): i for i in normal}), unknown)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The pieces of a SentencePiece model file with byte fallback; raises for a model that changes its texts."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    how = spec.normalizer_spec
    if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.add_dummy_prefix or not how.escape_whitespaces or not spec.trainer_spec.byte_fallback:
        raise ValueError("only models that leave a text as it is, add a prefix and fall back to bytes")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    names = [model.id_to_piece(i) for i in ids]
    byte_ids = [0] * 256
    for i in ids:
        if model.is_byte(i):
            byte_ids[int(names[i][1:-1], 16)] = i
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Pieces.of(names, [model.get_score(i) for i in ids], byte_ids, normal, model.unk_id())


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, pieces: Pieces):
        self.base, self.check, self.value = (np.asarray(x, np.int64) for x in (pieces.trie.base, pieces.trie.check, pieces.trie.value))
        self.scores, self.byte_ids = np.array(pieces.scores), np.array(pieces.byte_ids, np.int32)
        trie_ids = self.value[self.value >= 0]
        self.unknown_score = float(self.scores[trie_ids].min(initial=0.0)) - UNKNOWN_PENALTY
        as_byte = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        content = [as_byte.get(i) or name.replace(MARK, " ").encode() for i, name in enumerate(pieces.names)]
        self.content = UnitStore(np.uint8, most_units=len(content), most_bytes=0)
        self.content.add(np.frombuffer(b"".join(content), np.uint8), np.array([len(c) for c in content]))
        self.is_byte = np.zeros(len(pieces.names), dtype=bool)
        self.is_byte[list(pieces.byte_ids)] = True
        self.store = UnitStore(np.int32, most_units=REMEMBERED_UNITS, most_bytes=REMEMBERED_BYTES)

    # ---- Viterbi

    def viterbi(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, score) of the best paths of units, all of them advanced a byte at a time.

        text [unit, byte] is padded beyond each unit's size; sizes fall.  Of
        equal paths the one whose last piece starts first counts.
        """
        n, width = text.shape
        best = np.full((n, width + 1), -np.inf)
        came, by = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        best[:, 0] = 0.0
        for i in range(width):
            reach = np.searchsorted(-sizes, -i, "left")  # units longer than i
            rows = np.flatnonzero(best[:reach, i] > -np.inf)
            if not len(rows):
                continue
            so_far, lead = best[rows, i], text[rows, i]
            end = np.minimum(sizes[rows], i + 1 + (lead >= 0x80) + (lead >= 0xE0) + (lead >= 0xF0))
            covered = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, width):
                inside = sizes[rows[live]] > j
                live, state = live[inside], state[inside]
                to = self.base[state] + text[rows[live], j] + 1
                held = self.check[to] == state
                live, state = live[held], to[held]
                if not len(live):
                    break
                piece = self.value[state]
                ends = piece >= 0
                who, piece = live[ends], piece[ends]
                covered[who[end[who] == j + 1]] = True
                score, at = so_far[who] + self.scores[piece], rows[who]
                better = score > best[at, j + 1]
                at = at[better]
                best[at, j + 1], came[at, j + 1], by[at, j + 1] = score[better], i, piece[better]
            bare = np.flatnonzero(~covered)
            if len(bare):
                at, to, score = rows[bare], end[bare], so_far[bare] + self.unknown_score
                better = score > best[at, to]
                at, to = at[better], to[better]
                best[at, to], came[at, to], by[at, to] = score[better], i, -1
        # Back along the paths, a step of every unit at a time.
        steps = []
        rows, at = np.arange(n), sizes.copy()
        while len(rows):
            start, piece = came[rows, at], by[rows, at]
            steps.append((rows, start, at, piece))
            going = start > 0
            rows, at = rows[going], start[going]
        rows, start, at, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((at, rows))
        rows, start, at, piece = rows[order], start[order], at[order], piece[order]
        count = np.where(piece >= 0, 1, at - start)  # a character without a piece is its bytes
        place = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[place[piece >= 0]] = piece[piece >= 0]
        for k in range(4):
            more = np.flatnonzero((piece < 0) & (count > k))
            ids[place[more] + k] = self.byte_ids[text[rows[more], start[more] + k]]
        return ids, np.bincount(rows, count, n).astype(np.int64), best[np.arange(n), sizes]

    def matches(self, text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece that starts at places [first, last) of a text, by start and end; all starts walk the trie together."""
        live, state, found = np.arange(first, last), np.zeros(last - first, np.int64), [(np.zeros(0, np.int64),) * 3]
        for j in range(len(text)):
            inside = live + j < len(text)
            live, state = live[inside], state[inside]
            to = self.base[state] + text[live + j] + 1
            held = self.check[to] == state
            live, state = live[held], to[held]
            if not len(live):
                break
            ends = self.value[state] >= 0
            found.append((live[ends], live[ends] + j + 1, self.value[state[ends]]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, start))
        return start[order], end[order], piece[order]

    def long_path(self, text: np.ndarray) -> tuple[np.ndarray, float]:
        """(ids, score) of the best path of one unit, a match at a time: what ``viterbi`` gives, without a step of numpy for each byte."""
        size, nowhere, unknown = len(text), float("-inf"), self.unknown_score
        best, came, by = array("d", [nowhere]) * (size + 1), array("i", [0]) * (size + 1), array("i", [-1]) * (size + 1)
        best[0] = 0.0
        for first in range(0, size, STARTS_AT_ONCE):
            last = min(size, first + STARTS_AT_ONCE)
            start, end, piece = self.matches(text, first, last)
            bounds, ends, pieces, scores = np.searchsorted(start, np.arange(first, last + 1)).tolist(), end.tolist(), piece.tolist(), self.scores[piece].tolist()
            lead = text[first:last]
            whole = np.minimum(size, np.arange(first, last) + 1 + (lead >= 0x80) + (lead >= 0xE0) + (lead >= 0xF0)).tolist()
            for i in range(first, last):
                so_far = best[i]
                if so_far == nowhere:
                    continue
                bare, after = True, whole[i - first]
                for k in range(bounds[i - first], bounds[i - first + 1]):
                    to, score = ends[k], so_far + scores[k]
                    if to == after:
                        bare = False
                    if score > best[to]:
                        best[to], came[to], by[to] = score, i, pieces[k]
                if bare and so_far + unknown > best[after]:
                    best[after], came[after], by[after] = so_far + unknown, i, -1
        ids, at = array("i"), size
        while at:
            if by[at] >= 0:
                ids.append(by[at])
            else:
                ids.extend(self.byte_ids[text[came[at] : at][::-1]].tolist())
            at = came[at]
        return np.frombuffer(ids, np.int32)[::-1] if ids else np.zeros(0, np.int32), best[size]

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Slots of new units, longest first, in tables of a bounded size; those that few others are as long as, one by one."""
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out, at = np.empty(len(units), np.int64), 0
        rest = int(sizes[order[SIDE_BY_SIDE]]) if len(order) > SIDE_BY_SIDE else 0
        while at < len(order) and sizes[order[at]] > rest:
            ids, score = self.long_path(np.frombuffer(units[order[at]], np.uint8))
            out[order[at]] = self.store.add(ids, np.array([len(ids)]), np.array([score]))[0]
            at += 1
        while at < len(order):
            rows = order[at : at + max(1, CELLS_AT_ONCE // (int(sizes[order[at]]) + 1))]
            width, some = int(sizes[rows[0]]), sizes[rows]
            text = np.zeros((len(rows), width), np.uint8)
            text[np.arange(width) < some[:, None]] = np.frombuffer(b"".join([units[i] for i in rows.tolist()]), np.uint8)
            out[rows] = self.store.add(*self.viterbi(text, some))
            at += len(rows)
        return out

    # ---- texts

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marked = pc.replace_substring(texts.view(pa.string()), MARK, " ") if pc.any(pc.match_substring(texts, MARK)).as_py() else texts
        whole = [b" " + t if t else b"" for t in as_bytes(marked)]
        data = np.frombuffer(b"".join(whole), np.uint8)
        ends = np.cumsum([len(t) for t in whole])
        empty = (np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts)))
        if not len(data):
            return empty
        # A unit starts with a text, with the first of some spaces, with a line end and after one.
        space, line = data == 32, data == 10
        fresh = np.zeros(len(data), bool)
        fresh[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        fresh[0] = True
        fresh[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(fresh)
        marks = np.concatenate((starts, [len(data)])).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(marks), pa.py_buffer(data)]).dictionary_encode()
        mark = MARK.encode()
        slots = self.store.slots([u.replace(b" ", mark) for u in units.dictionary.to_numpy(zero_copy_only=False).tolist()], self._learn)[units.indices.to_numpy()]
        lengths = self.store.lengths(slots)
        last = np.searchsorted(starts, ends, "left")  # units up to each text's end
        before = np.concatenate(([0], np.cumsum(lengths)))
        first = np.concatenate(([0], last[:-1]))
        held, scores = last > first, np.zeros(len(texts))
        scores[held] = np.add.reduceat(self.store.scores(slots), first[held])
        return self.store.gather(slots, lengths), np.diff(before[last], prepend=0), scores

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids and log score of each); a null or empty text has no ids."""
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        for part in parts(texts.cast(pa.binary()).fill_null(b""), PART_BYTES):
            self.store.tidy()
            found.append(self._part(part))
        ids, counts, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids, counts, scores

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        ids, _, scores = self.encode_all(pa.array([text], pa.string()))
        return ids, float(scores[0])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of lists of ids that stand one after another."""
        lengths = self.content.lengths(ids)
        data = self.content.gather(ids, lengths).tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


# ---------------------------------------------------------------- Spark


class SentencePieces:
    """Encoding and decoding columns for one model file, which only the driver reads."""

    def __init__(self, spark, model_path: str):
        prepare(spark)
        self.key = model_path
        self.shared = spark.sparkContext.broadcast(load(model_path))  # as large as the vocabulary

    def _column(self, function, kind: str, source: Column) -> Column:
        function.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(function, kind)(source)

    def encode(self, text: Column) -> Column:
        """array<int> of piece ids; empty for a null or empty text."""
        key, shared = self.key, self.shared

        def encode(values: pa.Array) -> pa.Array:
            ids, counts, _ = _codec(key, shared).encode_all(values)
            give_back()
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))

        return self._column(encode, "array<int>", text)

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids; null for null."""
        key, shared = self.key, self.shared

        def decode(values: pa.Array) -> pa.Array:
            codec = _codec(key, shared)
            return pa.array([None if v is None else codec.decode(v) for v in values.to_pylist()], type=pa.string())

        return self._column(decode, "string", ids)

    def digest(self, text: Column) -> Column:
        """struct<n_pieces, n_bytes, ids_crc32, score, round_trip>, computed in one pass from encode and decode.

        ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
        """
        key, shared = self.key, self.shared

        def digest(values: pa.Array) -> pa.Array:
            codec = _codec(key, shared)
            ids, counts, scores = codec.encode_all(values)
            ends = np.cumsum(counts)
            n_bytes = np.diff(np.concatenate(([0], np.cumsum(codec.is_byte[ids])))[ends], prepend=0)
            raw = ids.astype("<i4").tobytes()
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            given = as_bytes(values.cast(pa.binary()).fill_null(b""))
            same = [t == (g.replace(MARK.encode(), b" ") if MARK.encode() in g else g) for t, g in zip(codec.decode_all(ids, counts), given, strict=True)]
            give_back()
            return pa.StructArray.from_arrays([pa.array(counts), pa.array(n_bytes.astype(np.int64)), pa.array(sums, pa.int64()), pa.array(scores), pa.array(same, pa.bool_())], ["n_pieces", "n_bytes", "ids_crc32", "score", "round_trip"])

        return self._column(digest, "n_pieces long, n_bytes long, ids_crc32 long, score double, round_trip boolean", text)


def piece_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the fields of ``SentencePieces.digest``; null counts as empty."""
    pieces = SentencePieces(docs.sparkSession, model_path)
    return docs.select(F.col(id_col).alias("doc_id"), pieces.digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")
