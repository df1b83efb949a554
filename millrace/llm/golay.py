"""The binary Golay code of length 23, read backwards as a fuzzy hash.

Every word of 23 bits lies within three flips of exactly one codeword. Two words at most two flips apart
have a word between them, one flip or none from each: decoding a word and its 23 neighbours gives one to a
handful of codewords, and words two flips apart always share one of these.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, DATA_BITS = 0b110001110101, 23, 12


@cache
def decode_table() -> np.ndarray:
    """The index of the nearest codeword of every word: 2^23 of 16 bits."""
    code = np.zeros(1, np.uint32)
    for i in range(DATA_BITS):
        code = np.concatenate([code, code ^ np.uint32(GENERATOR << i)])
    flips = [0]
    for i in range(LENGTH):
        flips.append(1 << i)
        for j in range(i):
            flips.append(1 << i | 1 << j)
            flips += [1 << i | 1 << j | 1 << k for k in range(j)]
    out = np.zeros(1 << LENGTH, np.uint16)
    index = np.arange(len(code), dtype=np.uint16)
    for e in flips:
        out[code ^ np.uint32(e)] = index
    return out


def fuzzy_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs, none twice: codeword indices of each word of ``width`` bits and of its neighbours."""
    table = decode_table()
    near = np.stack([table[words]] + [table[words ^ np.uint32(1 << i)] for i in range(width)], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows = np.nonzero(first)
    return rows[0], near[rows]
