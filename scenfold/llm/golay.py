"""Keys of bit vectors by decoding with the binary Golay code of length 23.

The code is perfect: every 23-bit word is at distance 3 or less of exactly one of its 4096 words. The
keys of a segment are the indices of the code words that the segment, or the segment with one
bit flipped, decodes to: one to six keys. Two segments that differ in two bits or fewer have a word
between them at distance 1 or less of both, and so a key in common.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA_BITS = 23, 12
CHECK_BITS = LENGTH - DATA_BITS
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = (22, 21, 21)  # of 64 bits, from the lowest


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each syndrome."""
    single = [remainder(1 << i) for i in range(LENGTH)]

    def syndromes(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for k, bit in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ single[bit]
        return out

    errors = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return syndromes(range(12)), syndromes(range(12, LENGTH)), errors


def decoded(words: np.ndarray) -> np.ndarray:
    """The index of the code word nearest to each 23-bit word."""
    low, high, errors = tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK_BITS


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of all distinct keys of segments of ``bits`` bits."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.int32)
    keys = np.sort(decoded(words[:, None] ^ flips), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows, places = np.nonzero(fresh)
    return rows, keys[rows, places]


def segments(prints: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for bits in SEGMENTS:
        out.append((prints >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int32))
        shift += bits
    return out


def keys_within_2(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key; vectors that differ in two bits or fewer have a key in common.

    One segment has no difference. If it is the only such one, the others have one difference each; else
    one of the two without a difference follows the other, in a circle. So a segment as it is, with a
    Golay key of the segment after it, makes a key of 33 bits or more.
    """
    parts, rows, keys = segments(prints), [], []
    for i in range(3):
        after = (i + 1) % 3
        r, code = segment_keys(parts[after], SEGMENTS[after])
        rows.append(r)
        keys.append((i << 40) + (parts[i][r].astype(np.int64) << DATA_BITS) + code)
    return np.concatenate(rows), np.concatenate(keys)


def keys_within_5(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key; vectors that differ in five bits or fewer have a key in common.

    At most one of three segments has three differences or more, so two segments share a Golay
    key each; the pair of both is a key. Most vectors that differ in up to eight bits share one, too.
    """
    found = [segment_keys(p, b) for p, b in zip(segments(prints), SEGMENTS, strict=True)]
    rows, keys = [], []
    for i, j in combinations(range(3), 2):
        (left_rows, left), (right_rows, right) = found[i], found[j]
        first = np.searchsorted(right_rows, np.arange(len(prints) + 1))
        times = (first[1:] - first[:-1])[left_rows]
        take = np.repeat(np.arange(len(left)), times)
        begin = np.repeat(np.cumsum(times) - times, times)
        other = first[left_rows[take]] + np.arange(len(take)) - begin
        rows.append(left_rows[take])
        keys.append(
            ((i + j) << 40) + (left[take].astype(np.int64) << DATA_BITS) + right[other]
        )
    return np.concatenate(rows), np.concatenate(keys)
