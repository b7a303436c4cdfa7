"""Ids of the units (words, pieces of text) that a worker has met, in a few arrays.

A batch of texts is cut into units and dictionary-encoded, so each distinct
unit is looked up once a batch, whatever its frequency; what is new goes to a
tokenizer.  The ids of all texts are then gathered by array operations.  The
store holds units up to a bound, beyond which only those of the last batch stay;
units longer than another bound live for one batch only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(max(need, 2 * len(self.held)) - self.size, self.held.dtype)))
        self.held[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class UnitStore:
    def __init__(self, kind, *, most_units: int, most_bytes: int):
        self.kind, self.most_units, self.most_bytes = np.dtype(kind), most_units, most_bytes
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {}
        self._last: list[bytes] = []
        self._ids, self._starts, self._lengths, self._scores = _Grown(self.kind), _Grown(np.int64), _Grown(np.int32), _Grown(np.float64)

    def tidy(self) -> None:
        """Between batches: if there is too much, forget all but the units of the last one."""
        if len(self.of) > self.most_units or self._ids.size > 16 * self.most_units:
            kept = [u for u in self._last[: self.most_units // 2] if u in self.of]
            slots = np.array([self.of[u] for u in kept], np.int64)
            lengths, scores = self.lengths(slots), self.scores(slots)
            ids = self.gather(slots, lengths)
            self.clear()
            self.of = dict(zip(kept, self.add(ids, lengths, scores).tolist(), strict=True))

    def add(self, ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """Slots of new units, whose ids come one unit after another."""
        first, at = self._starts.size, self._ids.size
        self._ids.extend(ids)
        self._starts.extend(at + np.cumsum(lengths) - lengths)
        self._lengths.extend(lengths)
        self._scores.extend(np.zeros(len(lengths)) if scores is None else scores)
        return np.arange(first, first + len(lengths))

    def slots(self, units: list[bytes], learn: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
        """A slot for each of the distinct units; ``learn`` gives those of new ones."""
        self._last = units
        found = list(map(self.of.get, units))
        new = [i for i, s in enumerate(found) if s is None]
        out = np.array([-1 if s is None else s for s in found] if new else found, dtype=np.int64)
        if new:
            fresh = [units[i] for i in new]
            slots = learn(fresh)
            out[new] = slots
            self.of.update(zip(fresh, slots.tolist(), strict=True))
            if max(map(len, fresh)) > self.most_bytes:
                for u in fresh:
                    if len(u) > self.most_bytes:
                        del self.of[u]
        return out

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self._lengths.values[slots].astype(np.int64)

    def scores(self, slots: np.ndarray) -> np.ndarray:
        return self._scores.values[slots]

    def gather(self, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of all slots, one after another."""
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, self.kind)
        return self._ids.values[np.repeat(self._starts.values[slots] - (ends - lengths), lengths) + np.arange(ends[-1])]


def as_bytes(values: pa.Array) -> list[bytes]:
    """The values of an array of strings or binaries, without decoding."""
    return values.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def parts(texts: pa.Array, most_bytes: int):
    """Slices of at most so many bytes, or of one text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most_bytes, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to
