"""A wavelet matrix: counts of symbols in any prefix of a sequence, by one bit vector a level.

Symbols are small integers.  Level by level, from the highest bit on, the sequence is split
stably into the symbols with bit 0 and those with bit 1; a level keeps only its bits, as 64-bit words
with the number of ones before each word.  ``rank`` then follows a symbol down the levels, for
many positions at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with constant-time counts of ones in any prefix."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[BitVector, int]] = []
        current = np.ascontiguousarray(symbols, np.uint8)
        for level in reversed(range(levels)):
            bits = (current >> level) & 1
            vector = BitVector(bits)
            self.levels.append((vector, len(bits) - vector.total))
            ones = bits.astype(bool)
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` symbols."""
        begin, end = np.zeros_like(at), at
        for depth, (vector, zeros) in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - depth)) & 1
            ones_begin, ones_end = vector.rank1(begin), vector.rank1(end)
            if one:
                begin, end = zeros + ones_begin, zeros + ones_end
            else:
                begin, end = begin - ones_begin, end - ones_end
        return end - begin
