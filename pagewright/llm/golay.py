"""The extended Golay code (24, 12, 8): a word's fuzzy keys are the codewords within distance four."""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011


def golay_codewords() -> np.ndarray:
    """The 4096 codewords of the extended code: 12 data bits, 11 check bits, one parity bit."""
    out = np.empty(4096, np.uint32)
    for data in range(4096):
        rest = data << 11
        for i in range(11, -1, -1):
            if rest >> (i + 11) & 1:
                rest ^= GENERATOR << i
        word = data << 11 | rest
        out[data] = word << 1 | word.bit_count() & 1
    return out


def error_patterns() -> np.ndarray:
    """For each of the 4096 syndromes the patterns of at most four errors that have it: six columns, 0 where fewer.

    Words of even weight have syndromes of patterns of even weight: none, one of two errors, or six of four. The empty
    pattern has a row of its own (syndrome 0), so that 0 can stand for no pattern elsewhere.
    """
    words = golay_codewords()
    spots = [1 << i for i in range(24)]
    table, filled = np.zeros((4096, 6), np.uint32), np.zeros(4096, int)
    for error in [*map(sum, combinations(spots, 2)), *map(sum, combinations(spots, 4))]:
        at = int(words[error >> 12]) & 0xFFF ^ error & 0xFFF
        # two errors leave no pattern of four with the same syndrome: those are six or one
        table[at, filled[at]] = error
        filled[at] += 1
    return table


_tables: list[np.ndarray] = []


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four of each segment's extended word: six columns, -1 where fewer."""
    if not _tables:
        _tables.extend((golay_codewords(), error_patterns()))
    words, table = _tables
    extended = (values << 1 | (np.bitwise_count(values) & 1)).astype(np.uint32)
    syndrome = words[extended >> 12] & 0xFFF ^ extended & 0xFFF
    errors = table[syndrome]
    keys = ((extended[:, None] ^ errors) >> 12).astype(np.int32)
    none = errors == 0
    none[:, 0] &= syndrome != 0
    keys[none] = -1
    return keys
