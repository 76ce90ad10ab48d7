"""In-memory text indexes of one document or block."""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes) -> np.ndarray:
    """Start places of all suffixes in byte order: sorted by seven bytes first, then by prefix doubling of
    what is still tied."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.zeros(n + 7, np.int64)
    text[:n] = np.frombuffer(data, np.uint8)
    text[:n] += 1
    key = text[:n].copy()
    for j in range(1, 7):
        key = key << 9 | text[j : j + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of each place in order, where its ties begin
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1  # after the text's end nothing comes, which is less than all
    width = 7
    while True:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            return order
        at = order[tied]
        key = first[tied] * (n + 1) + rank[np.minimum(at + width, n)]
        way = np.argsort(key)
        at, key = at[way], key[way]
        order[tied] = at
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new[tied] = differs
        first[tied] = tied[np.maximum.accumulate(np.where(differs, np.arange(len(tied)), 0))]
        rank[at] = first[tied] + 1
        width *= 2


def inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def extension(data: bytes, i: int, j: int, limit: int | None = None) -> int:
    """Length of the longest common extension of places i and j."""
    high = len(data) - max(i, j)
    if limit is not None:
        high = min(high, limit)
    step, low = 8, 0
    while low < high:  # doubling, then halving
        end = min(high, low + step)
        if data[i + low : i + end] != data[j + low : j + end]:
            break
        low, step = end, step * 2
    else:
        return high
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if data[i + low : i + middle] == data[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


NEAR = 64  # bytes up to which extensions are taken for all places together


def near_extensions(data: bytes, other: np.ndarray) -> np.ndarray:
    """For each place i the longest common extension with the earlier place other[i] (0 if that is negative),
    NEAR at most: eight bytes at a time."""
    n = len(data)
    words = np.ndarray((n + NEAR,), "<u8", data + bytes(NEAR + 8), 0, (1,))
    out = np.zeros(n, np.int64)
    i = np.flatnonzero(other >= 0)
    j = other[i]
    for step in range(0, NEAR, 8):
        differ = words[i + step] ^ words[j + step]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        out[i] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        i, j = i[same], j[same]
        if not len(i):
            break
    return np.minimum(out, n - np.arange(n))


def shared_extensions(data: bytes, order: np.ndarray) -> np.ndarray:
    """For each place in suffix order the longest common extension with any other place, NEAR at most."""
    n = len(data)
    words = np.ndarray((n + NEAR,), "<u8", data + bytes(NEAR + 8), 0, (1,))
    i, j = order[:-1], order[1:]
    pair = np.zeros(max(0, n - 1), np.int64)
    at = np.arange(len(pair))
    for step in range(0, NEAR, 8):
        differ = words[i[at] + step] ^ words[j[at] + step]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        pair[at] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        at = at[differ == 0]
        if not len(at):
            break
    pair = np.minimum(pair, n - np.maximum(i, j))
    return np.maximum(np.append(pair, 0), np.append(0, pair))[:n]


def lcp_array(data: bytes, order: np.ndarray) -> list[int]:
    """Longest common prefix of each suffix with the one before it in order, in linear time."""
    rank = inverse(order).tolist()
    sa = order.tolist()
    out, h = [0] * len(sa), 0
    for i in range(len(sa)):
        if rank[i]:
            j = sa[rank[i] - 1]
            h += extension(data, i + h, j + h)
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def smaller_neighbours(order: np.ndarray) -> tuple[list[int], list[int]]:
    """For each text place, the nearest suffix before and after it in order that starts earlier in the
    text (-1: none)."""
    sa = order.tolist()
    before, after = [-1] * len(sa), [-1] * len(sa)
    stack: list[int] = []
    for place in sa:
        while stack and stack[-1] > place:
            after[stack.pop()] = place
        if stack:
            before[place] = stack[-1]
        stack.append(place)
    return before, after


def transform(data: bytes) -> list[int]:
    """The Burrows-Wheeler transform with the empty suffix first; -1 stands before the whole text."""
    order = [len(data), *suffix_array(data).tolist()]
    return [data[i - 1] if i else -1 for i in order]


class RankIndex:
    """rank(c, i): how often byte c stands in places 0..i."""

    def __init__(self, data: bytes | list[int]):
        values = np.array(list(data), np.int64)
        self.places = {int(c): np.flatnonzero(values == c) for c in np.unique(values)}
        self.below = {}
        total = 0
        for c in sorted(self.places):
            self.below[c] = total
            total += len(self.places[c])

    def rank(self, c: int, i: int) -> int:
        return int(np.searchsorted(self.places[c], i, side="right")) if c in self.places else 0

    def step(self, interval: tuple[int, int], c: int) -> tuple[int, int]:
        """Backward search: the interval [low, high) of suffixes that start with c and then as before."""
        if c not in self.places:
            return (0, 0)
        return self.below[c] + self.rank(c, interval[0] - 1), self.below[c] + self.rank(c, interval[1] - 1)


def count_occurrences(data: bytes, pattern: bytes) -> int:
    column = transform(data)
    index = RankIndex(column)
    interval = (0, len(column))
    for c in reversed(pattern):
        interval = index.step(interval, c)
        if interval[0] >= interval[1]:
            return 0
    return interval[1] - interval[0]


class RangeMin:
    """Place of the leftmost least value in [i, j], by a sparse table."""

    def __init__(self, values: list[int]):
        self.values = np.array(values, np.int64)
        self.levels = [np.arange(len(values))]
        width = 1
        while width * 2 <= len(values):
            last = self.levels[-1]
            a, b = last[:-width], last[width:]
            self.levels.append(np.where(self.values[b] < self.values[a], b, a))
            width *= 2

    def query(self, i: int, j: int) -> int:
        level = (j - i + 1).bit_length() - 1
        a, b = int(self.levels[level][i]), int(self.levels[level][j - (1 << level) + 1])
        return b if self.values[b] < self.values[a] else a


def runs(data: bytes, longest_period: int | None = None) -> list[tuple[int, int, int]]:
    """(start, period, length) of all maximal repetitions of at least two periods, each with its least
    period; sorted, without repeats."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    found: dict[tuple[int, int], int] = {}
    for period in range(1, min(n // 2, longest_period or n) + 1):
        same = np.concatenate([[0], (a[period:] == a[:-period]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= period:
                found.setdefault((start, end + period), period)  # periods ascend: the least comes first
    return sorted((start, period, end - start) for (start, end), period in found.items())
