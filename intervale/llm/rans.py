"""Static range asymmetric numeral system over token ids.

One frequency table, scaled to a power of two, serves all blocks.  A block
interleaves ``lanes`` coders: token i belongs to lane i modulo lanes, so one
array step codes a token of every lane.  States are 63-bit and give up 32-bit
words.  A block carries its lanes' states at its start and, every
``CHECKPOINT`` steps, the states and word position from which decoding can
start in its middle, and checksums of its words and of its ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
CHECKPOINT = 128
MOST_BITS = 24


class Corrupt(ValueError):
    """A block whose checksum does not hold."""


@dataclass(frozen=True)
class Frequencies:
    """ids[i] takes the slots from starts[i] on, ``counts[i]`` of them, of 2**bits in all."""

    ids: np.ndarray
    counts: np.ndarray
    bits: int

    @staticmethod
    def scale(ids: np.ndarray, found: np.ndarray) -> Frequencies:
        """From counts of each id seen; every one of them keeps a slot at least."""
        order = np.argsort(ids)
        ids, found = ids[order].astype(np.int64), found[order].astype(np.float64)
        bits = min(MOST_BITS, max(12, int(len(ids)).bit_length() + 4))
        total = 1 << bits
        if not len(ids):
            return Frequencies(ids, np.zeros(0, np.int64), bits)
        exact = found / found.sum() * total
        counts = np.maximum(1, np.floor(exact)).astype(np.int64)
        by_size = np.argsort(-counts, kind="stable")
        over = int(counts.sum()) - total
        if over < 0:
            counts[by_size[0]] -= over
        for i in by_size:  # what rounding up has taken comes from the largest
            if over <= 0:
                break
            give = min(over, int(counts[i]) - 1)
            counts[i] -= give
            over -= give
        return Frequencies(ids, counts, bits)


@dataclass(frozen=True)
class Block:
    n: int
    lanes: int
    states: bytes  # uint64 of each lane where decoding starts
    words: bytes  # uint32
    checkpoints: bytes  # for each: uint64 word position, then the lanes' states
    words_crc32: int
    ids_crc32: int


class Coder:
    def __init__(self, table: Frequencies):
        self.table = table
        self.starts = np.concatenate(([0], np.cumsum(table.counts)[:-1])) if len(table.ids) else np.zeros(0, np.int64)
        self.f, self.c = table.counts.astype(np.uint64), self.starts.astype(np.uint64)
        self.bits, self.mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
        self.limit = ((LOW >> self.bits) << WORD) * self.f
        self.slot = np.repeat(np.arange(len(table.ids)), table.counts)
        self.rank = np.full(int(table.ids.max()) + 1 if len(table.ids) else 0, -1, dtype=np.int64)
        self.rank[table.ids] = np.arange(len(table.ids))

    def encode(self, ids: np.ndarray, lanes: int = 512) -> Block:
        n = len(ids)
        symbols = self.rank[ids]
        if n and symbols.min() < 0:
            raise ValueError("an id without a frequency")
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        for t in range(steps - 1, -1, -1):
            s = symbols[t * lanes : (t + 1) * lanes]
            live = x[: len(s)]
            f = self.f[s]
            full = live >= self.limit[s]
            words.append(live[full].astype(np.uint32))
            live = np.where(full, live >> WORD, live)
            q = live // f
            x[: len(s)] = (q << self.bits) + (live - q * f) + self.c[s]
            if t and t % CHECKPOINT == 0:
                marks.append((t, x.copy()))
        words.reverse()
        at = np.concatenate(([0], np.cumsum([len(w) for w in words]))) if words else np.zeros(1, np.int64)
        payload = np.concatenate(words).astype("<u4").tobytes() if words else b""
        checkpoints = b"".join(np.concatenate(([np.uint64(at[t])], states)).astype("<u8").tobytes() for t, states in reversed(marks))
        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
        return Block(n, lanes, x.astype("<u8").tobytes(), payload, checkpoints, zlib.crc32(payload), zlib.crc32(raw))

    def decode(self, block: Block, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids between two checkpoints (all by default) as uint32; raises Corrupt."""
        if zlib.crc32(block.words) != block.words_crc32:
            raise Corrupt("words")
        steps = -(-block.n // block.lanes)
        begin, end = first * CHECKPOINT, steps if last is None else min(steps, last * CHECKPOINT)
        words = np.frombuffer(block.words, dtype="<u4").astype(np.uint64)
        if first:
            mark = np.frombuffer(block.checkpoints, dtype="<u8").reshape(-1, block.lanes + 1)[first - 1]
            at, x = int(mark[0]), mark[1:].astype(np.uint64)
        else:
            at, x = 0, np.frombuffer(block.states, dtype="<u8").astype(np.uint64)
        out = np.empty(max(0, min(block.n, end * block.lanes) - begin * block.lanes), dtype=np.int64)
        for t in range(begin, end):
            k = min(block.lanes, block.n - t * block.lanes)
            live = x[:k]
            low = live & self.mask
            s = self.slot[low]
            out[(t - begin) * block.lanes :][:k] = s
            live = self.f[s] * (live >> self.bits) + low - self.c[s]
            dry = np.flatnonzero(live < LOW)
            live[dry] = live[dry] << WORD | words[at : at + len(dry)]
            at += len(dry)
            x[:k] = live
        ids = self.table.ids[out].astype("<u4")
        if first == 0 and last is None and zlib.crc32(ids.tobytes()) != block.ids_crc32:
            raise Corrupt("ids")
        return ids
