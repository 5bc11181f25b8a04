"""Vectorized 64-bit hashing of words and word sequences (numpy, arithmetic modulo 2**64).

Hashes depend on bytes alone: the same on every machine, run and Python version.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 20
_SPAN = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply and xor-shift rounds)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


BYTE_BASE, BLOCK_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95, 0xA0761D6478BD642F
BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTES_LOWER = BYTES[_LOWER]
_POWERS = powers(BYTE_BASE, _SPAN)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def segment_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each segment [starts, starts + length) of the bytes; segments are in order, apart
    and not empty."""
    if not len(starts):
        return np.zeros(0, U)
    held = np.add.accumulate(lengths)
    first = held - lengths
    within = np.arange(int(held[-1]), dtype=np.int64) - np.repeat(first, lengths)
    value = (BYTES_LOWER if lower else BYTES)[data[within + np.repeat(starts, lengths)]]
    if int(lengths.max()) <= _SPAN:
        value *= _POWERS[within]
    else:
        value *= _POWERS[within % _SPAN] * powers(BLOCK_BASE, int(lengths.max()) // _SPAN + 1)[within // _SPAN]
    return mix(np.add.reduceat(value, first) + lengths.astype(U))


def word_hashes(data: np.ndarray, lower: bool = False, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every word, in order; gaps tells which bytes lie between words. Works in chunks cut at white space, so that
    memory follows the number of words and the longest word."""
    hashes, starts, sizes = [], [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n:
            gap = np.flatnonzero(gaps[data[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + CHUNK)
        part = data[at:end]
        edge = np.diff(np.concatenate(([0], (~gaps[part]).view(np.int8), [0])))
        begin = np.flatnonzero(edge == 1)
        length = np.flatnonzero(edge == -1) - begin
        hashes.append(segment_hashes(part, begin, length, lower))
        starts.append(begin + at)
        sizes.append(length)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of k consecutive words, for every start that has k words (documents not yet told apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8:
        out = np.zeros(n, U)
        for j in range(k):
            out *= U(WORD_BASE)
            out += words[j : j + n]
        return mix(out + U(k))
    # sums over prefixes; the factor of the start is divided out by the inverse of the odd base
    up = powers(WORD_BASE, len(words))
    down = powers(pow(WORD_BASE, -1, 1 << 64), len(words))
    total = np.concatenate((np.zeros(1, U), np.add.accumulate(words * up)))
    return mix((total[k:] - total[:n]) * down[:n] + U(k))


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of words [start, end) for many ranges."""
    up = powers(WORD_BASE, len(words) + 1)
    down = powers(pow(WORD_BASE, -1, 1 << 64), len(words) + 1)
    total = np.concatenate((np.zeros(1, U), np.add.accumulate(words * up[:-1])))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
