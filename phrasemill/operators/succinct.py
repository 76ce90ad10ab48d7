"""Compressed sequences with rank and access: bit vectors, block classes, Elias-Fano, a wavelet tree."""

from __future__ import annotations

from bisect import bisect_right
from math import comb

import numpy as np


class BitRank:
    """rank1 and rank0, inclusive, over packed bits with a count before every 64-bit word."""

    def __init__(self, bits: list[int] | np.ndarray):
        bits = np.asarray(bits, np.uint8)
        self.n = len(bits)
        padded = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, i: int) -> int:
        if i < 0:
            return 0
        word, bit = divmod(i, 64)
        mask = np.uint64((1 << (bit + 1)) - 1)
        return int(self.before[word]) + int(np.bitwise_count(self.words[word] & mask))

    def rank0(self, i: int) -> int:
        return i + 1 - self.rank1(i) if i >= 0 else 0

    def between(self, i: int, j: int) -> int:
        """Set bits in [i, j]."""
        return self.rank1(j) - self.rank1(i - 1)

    def access(self, i: int) -> int:
        return int(self.words[i // 64] >> np.uint64(i % 64)) & 1


class ClassVector:
    """Bits in blocks, each stored as its class (set bits) and its number within the class."""

    def __init__(self, bits: list[int], block: int = 15, every: int = 8):
        self.n, self.block, self.every = len(bits), block, every
        self.classes, self.numbers, self.before = [], [], []
        total = 0
        for at in range(0, len(bits), block):
            own = bits[at : at + block]
            if len(self.classes) % every == 0:
                self.before.append(total)
            self.classes.append(sum(own))
            self.numbers.append(self._number(own))
            total += sum(own)

    @staticmethod
    def _number(bits: list[int]) -> int:
        """How many words of this class come before: the combinatorial number system."""
        seen, out = 0, 0
        for i, bit in enumerate(bits):
            if bit:
                seen += 1
                out += comb(i, seen)
        return out

    def _bits(self, k: int) -> list[int]:
        left, number = self.classes[k], self.numbers[k]
        out = [0] * self.block
        for i in range(self.block - 1, -1, -1):
            if left and number >= comb(i, left):
                number -= comb(i, left)
                left -= 1
                out[i] = 1
        return out

    def access(self, i: int) -> int:
        return self._bits(i // self.block)[i % self.block]

    def rank1(self, i: int) -> int:
        k = i // self.block
        start = k // self.every
        return self.before[start] + sum(self.classes[start * self.every : k]) + sum(self._bits(k)[: i % self.block + 1])


class EliasFano:
    """A non-decreasing sequence: low bits apart, high bits in unary; access and predecessor."""

    def __init__(self, values: list[int]):
        self.n = len(values)
        reach = (values[-1] + 1) if values else 1
        self.low_bits = max(0, (reach // max(1, self.n)).bit_length() - 1)
        mask = (1 << self.low_bits) - 1
        self.low = [v & mask for v in values]
        unary = [0] * (self.n + (reach >> self.low_bits) + 1)
        for i, v in enumerate(values):
            unary[(v >> self.low_bits) + i] = 1
        self.ones = np.flatnonzero(unary)

    def access(self, i: int) -> int:
        return (int(self.ones[i]) - i) << self.low_bits | self.low[i]

    def predecessor(self, x: int) -> int:
        """Index of the last value at or below x, or -1."""
        return bisect_right(range(self.n), x, key=self.access) - 1


class WaveletTree:
    """rank(c, i) of any byte by one bit rank for each level of a balanced tree over the alphabet."""

    def __init__(self, data: bytes):
        self.alphabet = sorted(set(data))
        code = {c: i for i, c in enumerate(self.alphabet)}
        self.depth = max(1, (len(self.alphabet) - 1).bit_length()) if self.alphabet else 0
        self.levels: dict[tuple[int, int], BitRank] = {}
        parts = {0: np.array([code[c] for c in data], np.int64)}
        for level in range(self.depth):
            shift, nxt = self.depth - 1 - level, {}
            for node, own in parts.items():
                bits = (own >> shift) & 1
                self.levels[level, node] = BitRank(bits)
                for side in (0, 1):
                    if (bits == side).any():
                        nxt[node * 2 + side] = own[bits == side]
            parts = nxt
        self.code = code

    def rank(self, c: int, i: int) -> int:
        if c not in self.code or i < 0:
            return 0
        symbol, node = self.code[c], 0
        for level in range(self.depth):
            bits = self.levels.get((level, node))
            if bits is None:
                return 0
            side = (symbol >> (self.depth - 1 - level)) & 1
            i = (bits.rank1(i) if side else bits.rank0(i)) - 1
            if i < 0:
                return 0
            node = node * 2 + side
        return i + 1
