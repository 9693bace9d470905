"""The binary Golay code [23, 12, 7] and fuzzy keys from it.

The code is perfect: every 23-bit word has exactly one codeword at distance 3 or less. The
keys of a word are the codewords nearest to the word and to each of its 23 neighbours: one
key where the word lies within 2 of its codeword, six otherwise. Two words that differ in at
most two bits have a common neighbour (or are neighbours), so they share a key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 23
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def nearest() -> np.ndarray:
    """For every 23-bit word, the index (its upper 12 bits) of the nearest codeword."""
    words = np.arange(1 << BITS, dtype=np.uint32)

    def syndrome(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for bit in range(BITS - 1, 10, -1):
            w ^= np.where(w >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return w

    errors = np.zeros(1 << 11, np.uint32)
    single = [1 << i for i in range(BITS)]
    few = [0, *single]
    few += [single[a] | single[b] for a in range(BITS) for b in range(a)]
    few += [
        single[a] | single[b] | single[c] for a in range(BITS) for b in range(a) for c in range(b)
    ]
    few = np.array(few, np.uint32)
    errors[syndrome(few)] = few
    return ((words ^ errors[syndrome(words)]) >> np.uint32(11)).astype(np.uint16)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the distinct keys of every 23-bit word, for differences up to two."""
    table, w = nearest(), words.astype(np.uint32)
    own = table[w]
    found = [own] + [table[w ^ np.uint32(1 << i)] for i in range(BITS)]
    every = np.sort(np.stack(found, 1), 1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    rows, at = np.nonzero(new)
    return rows, every[rows, at]


def near_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``keys`` for differences up to one: about half as many.

    Of two neighbours' nearest codewords the lesser one is a key of both, so a word keeps its
    own and those of its keys that are less.
    """
    rows, found = keys(words)
    own = nearest()[words.astype(np.uint32)]
    keep = found <= own[rows]
    return rows[keep], found[keep]
