"""The binary Golay code of 23 bits, used as a fuzzy hash.

Every word of 23 bits lies within 3 bits of exactly one of the 4096 codewords. A word at distance 3
lies at distance 4 from five others. Taking the one codeword, or those six, as a word's keys, any two words
that differ in at most two bits share a key (checked over all words and errors in the tests).
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, MESSAGE, PARITY = 23, 12, 11


def _parity(message: np.ndarray) -> np.ndarray:
    rest = message.astype(np.int64) << PARITY
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - PARITY)), rest)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each message, error patterns of each syndrome: one, or six; unused places are -1)."""
    parity = _parity(np.arange(1 << MESSAGE))
    errors = np.full((1 << PARITY, 6), -1, dtype=np.int64)
    used = np.zeros(1 << PARITY, dtype=np.int64)
    least = np.full(1 << PARITY, 9, dtype=np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = (e & ((1 << PARITY) - 1)) ^ int(parity[e >> PARITY])
            if weight <= least[s] or (weight == 4 and least[s] == 3):
                least[s] = min(least[s], weight)
                errors[s, used[s]] = e
                used[s] += 1
    return parity, errors


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of each key of each 23-bit word."""
    parity, errors = tables()
    words = words.astype(np.int64)
    syndrome = (words & ((1 << PARITY) - 1)) ^ parity[words >> PARITY]
    found = errors[syndrome]
    row, place = np.nonzero(found >= 0)
    return row, (words[row] ^ found[row, place]) >> PARITY
