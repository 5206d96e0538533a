"""Arrays that stand for tables of lists and for hash tables, so that lookups of many values are a few array operations."""

from __future__ import annotations

import numpy as np

TIMES = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """From whole numbers of 0 or more to int32 values, open-addressed at a load of an eighth or less."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            rest = self.keys[at] != keys
            here = ~rest
            self.values[at[here]] = values[here]
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * TIMES >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of int64 ``keys``, -1 where there is none."""
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        again = np.flatnonzero((there != keys) & (there != -1))
        while len(again):
            at[again] = at[again] + 1 & self.mask
            there = self.keys[at[again]]
            hit = there == keys[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (there != -1)]
        return out


class Ragged:
    """Lists of numbers one after another: list ``i`` is ``flat[starts[i] : starts[i] + lengths[i]]``."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, index: np.ndarray) -> Ragged:
        """The lists of ``index``, in its order."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(self.starts[index] - (ends - lengths), lengths)
        return Ragged(self.flat[at], lengths)

    def joined(self, counts: np.ndarray) -> Ragged:
        """Each ``counts[i]`` lists in turn put together as one."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return Ragged(self.flat, np.diff(bounds))

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))
