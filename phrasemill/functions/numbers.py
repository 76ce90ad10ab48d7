"""Integer helpers shared by summaries and indexes."""

from __future__ import annotations

import numpy as np

M61 = (1 << 61) - 1
_WORD = (1 << 64) - 1


def mod61(x: int) -> int:
    return x % M61


def mulmod61(a: int, b: int) -> int:
    return a * b % M61


def power61(base: int, exponent: int) -> int:
    return pow(base, exponent, M61)


def mix64(x: int) -> int:
    """A 64-bit finishing hash."""
    x &= _WORD
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    return x ^ (x >> 31)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def top_different_bit(x: int, y: int) -> int:
    return (x ^ y).bit_length() - 1


def keep_top(x: int, i: int) -> int:
    """x with the bits below i cleared."""
    return x >> i << i


def next_permutation(v: int) -> int:
    """The next larger number with as many set bits."""
    low = v & -v
    up = v + low
    return up | (((v ^ up) // low) >> 2)


def parse_size(text: str) -> int:
    """Sizes with SI (K, M, G) or IEC (Ki, Mi, Gi) units."""
    units = {"Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30, "K": 10**3, "M": 10**6, "G": 10**9}
    for unit, factor in units.items():
        if text.endswith(unit):
            return int(text[: -len(unit)]) * factor
    return int(text)


class PrefixPrints:
    """Fingerprints of all prefixes, so that any substring's is two operations."""

    def __init__(self, data: bytes, base: int):
        self.base, prints, powers = base, [0], [1]
        h, p = 0, 1
        for c in data:
            h = (h * base + c) % M61
            p = p * base % M61
            prints.append(h)
            powers.append(p)
        self.prints, self.powers = prints, powers

    def of(self, start: int, end: int) -> int:
        return (self.prints[end] - self.prints[start] * self.powers[end - start]) % M61


def _times61(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo M61 of many numbers below M61, not reduced to below M61: under 2**62."""
    high, low, a, b = x >> np.uint64(31), x & np.uint64((1 << 31) - 1), np.uint64(factor >> 31), np.uint64(factor & (1 << 31) - 1)
    middle = high * b + low * a
    out = high * a * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + low * b
    return (out & np.uint64(M61)) + (out >> np.uint64(61))


def window_prints(data: bytes, base: int, exponent: int) -> list[np.ndarray]:
    """For each exponent from 0 on, the fingerprints PrefixPrints.of of all windows of 2**exponent bytes, by doubling."""
    found = [np.frombuffer(data, np.uint8).astype(np.uint64)]
    for e in range(exponent):
        size, last = 1 << e, found[-1]
        out = _times61(last[:-size], pow(base, size, M61)) + last[size:]
        out = (out & np.uint64(M61)) + (out >> np.uint64(61))
        found.append(np.where(out >= np.uint64(M61), out - np.uint64(M61), out))
    return found


def mix64s(x: np.ndarray) -> np.ndarray:
    """mix64 of many numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roll(fp: int, base: int, out_power: int, old: int, new: int) -> int:
    """The fingerprint of a window one place on; out_power: base to the window's length."""
    return (fp * base - out_power * old + new) % M61
