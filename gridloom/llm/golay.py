"""The perfect binary Golay code (23, 12, 7): decoding by syndrome, and the codewords near a word."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial of the code.
GENERATOR = 0b110001110101
BITS = 23


def remainder(v: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes' values (3, 256); the error pattern of weight 3 or less of each syndrome (2048)."""
    of_bit = [remainder(1 << i) for i in range(BITS)] + [0]
    syn = np.zeros((3, 256), np.int32)
    for b in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1:
                    syn[b, v] ^= of_bit[b * 8 + i]
    leader = np.full(2048, -1, np.int32)
    for w in range(4):
        for bits in combinations(range(BITS), w):
            s = e = 0
            for i in bits:
                s ^= of_bit[i]
                e ^= 1 << i
            leader[s] = e
    return syn, leader, np.array(of_bit[:BITS], np.int32)


def syndrome(v: np.ndarray) -> np.ndarray:
    syn, _, _ = tables()
    return syn[0, v & 255] ^ syn[1, v >> 8 & 255] ^ syn[2, v >> 16 & 127]


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the only codeword at distance 3 or less from each 23-bit word."""
    return (v ^ tables()[1][syndrome(v)]) >> 11


@cache
def near(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: what to xor to v >> 11 for the index of each word within one flip of the low width bits.

    Returns (2048, 6) and how many of the six count. Six are enough: a word at distance 3 from its codeword has at
    most five other codewords at distance 4, and words that are nearer have none.
    """
    _, leader, of_bit = tables()
    out, count = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int32)
    for s in range(2048):
        found = {int(leader[s]) >> 11: None}
        for i in range(width):
            found[((1 << i) ^ int(leader[s ^ of_bit[i]])) >> 11] = None
        out[s, : len(found)], count[s] = list(found), len(found)
    return out, count


def decode_near(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords that v or a word one flip away decodes to, and how many of them count."""
    off, count = near(width)
    s = syndrome(v)
    return (v >> 11)[:, None] ^ off[s], count[s]
