"""Bounded-memory summaries of a stream: frequent strings, frequent prefixes, sketches, an attractor.

The sequential classes reproduce the order-dependent semantics (one ordered stream for each instance); the
mergeable forms, which scale over partitions, are in ``topk.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from phrasemill.functions.numbers import mix64, mix64s


class Counters:
    """Capped counters in buckets by frequency, with a lazy global decrement.

    The effective count of an item is max(freq, threshold) - threshold. Linked items of the threshold's
    bucket are garbage, the last one pushed first. When the threshold reaches half the cap, all counts are
    aged: halved, with the threshold back at zero.
    """

    def __init__(self, size: int, max_freq: int, on_renormalize: Callable[[], None] | None = None):
        self.cap = max(2, max_freq - 1)
        self.freq = [0] * size
        self.threshold = 0
        self.linked: dict[int, dict[int, None]] = {}
        self.where: list[int | None] = [None] * size
        self.on_renormalize = on_renormalize

    def link(self, v: int) -> None:
        level = max(self.freq[v], self.threshold)
        self.linked.setdefault(level, {})[v] = None
        self.where[v] = level

    def unlink(self, v: int) -> None:
        level = self.where[v]
        if level is None:
            return
        bucket = self.linked[level]
        del bucket[v]
        if not bucket:
            del self.linked[level]
        self.where[v] = None

    def increment(self, v: int) -> None:
        f = max(self.freq[v], self.threshold)
        if f >= self.cap:
            return
        was = self.where[v] is not None
        if was:
            self.unlink(v)
        self.freq[v] = f + 1
        if was:
            self.link(v)

    def decrement(self, v: int) -> None:
        f = max(self.freq[v], self.threshold)
        if f <= self.threshold:
            return
        was = self.where[v] is not None
        if was:
            self.unlink(v)
        self.freq[v] = f - 1
        if was:
            self.link(v)

    def garbage(self) -> int | None:
        bucket = self.linked.get(self.threshold)
        return next(reversed(bucket)) if bucket else None

    def decrement_all(self) -> None:
        self.threshold += 1
        if self.threshold * 2 >= self.cap:
            self.renormalize()

    def renormalize(self) -> None:
        order = [v for level in sorted(self.linked) for v in self.linked[level]]
        self.freq = [(max(f, self.threshold) - self.threshold) // 2 for f in self.freq]
        self.threshold, self.linked = 0, {}
        for v in order:
            self.link(v)
        if self.on_renormalize:
            self.on_renormalize()

    def reset(self, v: int) -> None:
        """A recycled item starts at one above the threshold."""
        self.freq[v] = self.threshold + 1

    def count(self, v: int) -> int:
        return max(self.freq[v], self.threshold) - self.threshold

    def extract_min(self) -> int | None:
        if not self.linked:
            return None
        v = next(reversed(self.linked[min(self.linked)]))
        self.unlink(v)
        return v

    def population(self) -> dict[int, int]:
        """How many linked items every frequency has."""
        return {level - self.threshold: len(bucket) for level, bucket in sorted(self.linked.items())}


class StringSummary:
    """Misra-Gries over whole items: insert returns the item's slot, or None if it was not taken in."""

    def __init__(self, k: int, max_freq: int = 1 << 30):
        self.k, self.counters = k, Counters(k, max_freq)
        self.slot: dict = {}
        self.item: list = []

    def insert(self, item) -> int | None:
        slot = self.slot.get(item)
        if slot is not None:
            self.counters.increment(slot)
            return slot
        if len(self.item) < self.k:
            slot = len(self.item)
            self.item.append(item)
        else:
            slot = self.counters.garbage()
            if slot is None:
                self.counters.decrement_all()
                return None
            self.counters.unlink(slot)
            del self.slot[self.item[slot]]
            self.item[slot] = item
        self.slot[item] = slot
        self.counters.reset(slot)
        self.counters.link(slot)
        return slot

    def find(self, item) -> int | None:
        return self.slot.get(item)

    def report(self) -> list[tuple]:
        return [(item, self.counters.count(slot)) for item, slot in self.slot.items()]


class PrefixSummary:
    """Misra-Gries over prefixes: a trie of at most k nodes (root included) whose leaves are linked.

    A state is (node, length, frequent). Extending a frequent state follows and counts the child; where
    there is none the missing string is tried to be taken in, and the state stops being frequent.
    """

    def __init__(self, k: int, max_freq: int = 1 << 30, on_insert: Callable[[int], None] | None = None, on_delete: Callable[[int], None] | None = None):
        self.k = max(2, k - 1)  # ids 0..k-2: as many nodes as the parsers' reference numbering has
        self.counters = Counters(self.k, max_freq)
        self.parent, self.label = [-1] * self.k, [-1] * self.k
        self.child: dict[int, int] = {}
        self.degree = [0] * self.k
        self.on_insert, self.on_delete = on_insert, on_delete
        for v in range(1, self.k):  # free nodes are garbage from the start; the highest id is used first
            self.counters.link(v)

    EMPTY = (0, 0, True)

    def extend(self, state: tuple[int, int, bool], c: int) -> tuple[int, int, bool]:
        node, length, frequent = state
        if not frequent:
            return node, length + 1, False
        child = self.child.get(node << 8 | c)
        if child is not None:
            self.counters.increment(child)
            return child, length + 1, True
        self._insert(node, c)
        return node, length + 1, False

    def feed(self, data: bytes, start: int, end: int, step: int = 1) -> list[int]:
        """Extend from the empty state by the bytes from start on, before end, until the state stops being frequent;
        the nodes on the way. As extend does, but without a call for each byte."""
        child, counters = self.child, self.counters
        freq, where, linked, cap, threshold = counters.freq, counters.where, counters.linked, counters.cap, counters.threshold
        node, way = 0, []
        for i in range(start, end, step):
            nxt = child.get(node << 8 | data[i])
            if nxt is None:
                self._insert(node, data[i])
                break
            f = freq[nxt]
            if f < threshold:
                f = threshold
            if f < cap:
                freq[nxt] = f + 1
                level = where[nxt]
                if level is not None:
                    bucket = linked[level]
                    del bucket[nxt]
                    if not bucket:
                        del linked[level]
                    bucket = linked.get(f + 1)
                    if bucket is None:
                        linked[f + 1] = {nxt: None}
                    else:
                        bucket[nxt] = None
                    where[nxt] = f + 1
            node = nxt
            way.append(node)
        return way

    def windows(self, data: bytes, starts: Iterable[int], window: int, ended: list[int] | None = None) -> Iterator[list[int]]:
        """feed with the window at each start, one when asked for the next: in one frame for all of them, without hooks.
        Only the last node on a way can be a leaf, so it alone changes buckets. ended: set to -1 for a recycled node."""
        counters, child, get = self.counters, self.child, self.child.get
        parent, label, degree, where, cap = self.parent, self.label, self.degree, counters.where, counters.cap
        freq, linked, threshold = counters.freq, counters.linked, counters.threshold
        for at in starts:
            node, way, missing = 0, [], -1
            for c in data[at : at + window]:
                nxt = get(node << 8 | c)
                if nxt is None:
                    missing = c
                    break
                f = freq[nxt]
                if f < threshold:
                    f = threshold
                if f < cap:
                    freq[nxt] = f + 1
                node = nxt
                way.append(node)
            level, f = where[node], freq[node]
            if level is not None and level != f:
                bucket = linked[level]
                del bucket[node]
                if not bucket:
                    del linked[level]
                where[node] = f
                if f in linked:
                    linked[f][node] = None
                else:
                    linked[f] = {node: None}
            if missing < 0:
                yield way
                continue
            garbage = linked.get(threshold)
            v = next(reversed(garbage)) if garbage else node
            if v == node:
                counters.decrement_all()
                freq, linked, threshold = counters.freq, counters.linked, counters.threshold
                yield way
                continue
            del garbage[v]
            if not garbage:
                del linked[threshold]
            old = parent[v]
            if old >= 0:
                del child[old << 8 | label[v]]
                degree[old] -= 1
                if not degree[old] and old:
                    counters.link(old)
            if not degree[node] and node:
                f = where[node]
                bucket = linked[f]
                del bucket[node]
                if not bucket:
                    del linked[f]
                where[node] = None
            parent[v], label[v] = node, missing
            child[node << 8 | missing] = v
            degree[node] += 1
            f = threshold + 1
            freq[v] = where[v] = f
            if f in linked:
                linked[f][v] = None
            else:
                linked[f] = {v: None}
            if ended:
                ended[v] = -1
            yield way

    def _insert(self, node: int, c: int) -> None:
        counters = self.counters
        linked, threshold = counters.linked, counters.threshold
        garbage = linked.get(threshold)
        if garbage is None:
            counters.decrement_all()
            return
        v = next(reversed(garbage))
        if v == node:
            counters.decrement_all()
            return
        where = counters.where
        del garbage[v]
        if not garbage:
            del linked[threshold]
        old = self.parent[v]
        if old >= 0:
            if self.on_delete:
                self.on_delete(v)
            del self.child[old << 8 | self.label[v]]
            self.degree[old] -= 1
            if not self.degree[old] and old:
                counters.link(old)
        if node and not self.degree[node]:
            counters.unlink(node)
        self.parent[v], self.label[v] = node, c
        self.child[node << 8 | c] = v
        self.degree[node] += 1
        counters.freq[v] = where[v] = threshold + 1  # as recycled items begin
        bucket = linked.get(threshold + 1)
        if bucket is None:
            linked[threshold + 1] = {v: None}
        else:
            bucket[v] = None
        if self.on_insert:
            self.on_insert(v)

    def longest(self, data: bytes, at: int, limit: int) -> tuple[int, int]:
        """(node, depth) of the longest string in the trie that data[at:limit] starts with."""
        node, depth, child = 0, 0, self.child
        while at + depth < limit:
            nxt = child.get(node << 8 | data[at + depth])
            if nxt is None:
                break
            node, depth = nxt, depth + 1
        return node, depth

    def spell(self, node: int) -> bytes:
        out = bytearray()
        while node > 0:
            out.append(self.label[node])
            node = self.parent[node]
        out.reverse()
        return bytes(out)

    def strings(self) -> list[tuple[bytes, int]]:
        return [(self.spell(v), self.counters.count(v)) for v in sorted(self.child.values())]

    def edges(self) -> list[tuple[int, int, int, int, int]]:
        """(node, parent, label, depth, freq) of every node but the root."""
        return [(v, self.parent[v], self.label[v], len(self.spell(v)), self.counters.count(v)) for v in sorted(self.child.values())]


class CountMin:
    """A Count-Min sketch of d rows; conservative: only the least cells grow."""

    def __init__(self, rows: int, columns: int, conservative: bool = False):
        self.columns = 1 << max(0, columns - 1).bit_length()
        self.cells = [[0] * self.columns for _ in range(rows)]
        self.conservative = conservative

    def _places(self, item: int) -> list[int]:
        """The item's cell in every row."""
        return [mix64(item ^ (0x9E3779B97F4A7C15 * (r + 1))) & (self.columns - 1) for r in range(len(self.cells))]

    def increment(self, item: int, by: int = 1) -> int:
        """Count by more of the item; returns the new estimate."""
        places = self._places(item)
        if self.conservative:
            new = min(row[p] for row, p in zip(self.cells, places, strict=True)) + by
            for row, p in zip(self.cells, places, strict=True):
                row[p] = max(row[p], new)
        else:
            for row, p in zip(self.cells, places, strict=True):
                row[p] += by
        return self.estimate(item)

    def estimate(self, item: int) -> int:
        return min(row[p] for row, p in zip(self.cells, self._places(item), strict=True))

    def merge(self, other: CountMin) -> None:
        for mine, its in zip(self.cells, other.cells, strict=True):
            for i, n in enumerate(its):
                mine[i] += n


class LinearCountMin(CountMin):
    """A Count-Min sketch of whole numbers whose rows hash by (a * x + b) mod a prime, as sketch_cells does."""

    def __init__(self, factors: list[tuple[int, int]], prime: int, columns: int, conservative: bool = False):
        super().__init__(len(factors), columns, conservative)
        self.factors, self.prime = factors, prime

    def _places(self, item: int) -> list[int]:
        return [(item % self.prime * a + b) % self.prime % self.columns for a, b in self.factors]


class MinBuckets:
    """A priority queue by frequency in buckets: insert, increase_key, remove, extract_min."""

    def __init__(self) -> None:
        self.buckets: dict[int, dict] = {}
        self.freq: dict = {}

    def insert(self, item, freq: int) -> None:
        self.freq[item] = freq
        self.buckets.setdefault(freq, {})[item] = None

    def remove(self, item) -> int:
        freq = self.freq.pop(item)
        del self.buckets[freq][item]
        if not self.buckets[freq]:
            del self.buckets[freq]
        return freq

    def increase_key(self, item) -> None:
        self.insert(item, self.remove(item) + 1)

    def min_frequency(self) -> int:
        return min(self.buckets) if self.buckets else 0

    def extract_min(self):
        item = next(iter(self.buckets[self.min_frequency()]))
        self.remove(item)
        return item


class SketchStrings:
    """Top-k items by a filter of k items over a Count-Min sketch: an item enters when its estimate
    exceeds the filter's least count; what an evicted item gained in the filter goes back to the sketch."""

    ROWS, COLUMNS = 2, 1 << 16

    def __init__(self, k: int, rows: int = ROWS, columns: int = COLUMNS):
        self.k, self.sketch, self.queue = k, CountMin(rows, columns), MinBuckets()
        self.entered: dict = {}

    @staticmethod
    def _key(item) -> int:
        return int.from_bytes(item, "little") if isinstance(item, bytes) else hash(item)

    def insert(self, item) -> bool:
        """Whether the item is in the filter now."""
        if item in self.queue.freq:
            self.queue.increase_key(item)
            return True
        if len(self.queue.freq) < self.k:
            self._enter(item, 1, 1)
            return True
        estimate = self.sketch.increment(mix64(self._key(item)))
        if estimate <= self.queue.min_frequency():
            return False
        out = self.queue.extract_min_with_freq()
        gained = out[1] - self.entered.pop(out[0])
        if gained > 0:
            self.sketch.increment(mix64(self._key(out[0])), gained)
        self._enter(item, estimate, estimate)
        return True

    def _enter(self, item, freq: int, entered: int) -> None:
        self.queue.insert(item, freq)
        self.entered[item] = entered if entered > 1 else 0

    def find(self, item) -> bool:
        return item in self.queue.freq

    def report(self) -> list[tuple]:
        return list(self.queue.freq.items())


def _extract_with_freq(self: MinBuckets) -> tuple:
    freq = self.min_frequency()
    return self.extract_min(), freq


MinBuckets.extract_min_with_freq = _extract_with_freq


class SketchPrefixes(PrefixSummary):
    """The prefix summary over a sketch: a missing string is counted in the sketch and replaces a leaf
    only when its estimate exceeds the least leaf's count."""

    def __init__(self, k: int, max_freq: int = 1 << 30, rows: int = 2, columns: int = 1 << 16, **hooks):
        super().__init__(k, max_freq, **hooks)
        self.sketch = CountMin(rows, columns, conservative=True)

    def _insert(self, node: int, c: int) -> None:
        if self.counters.garbage() is None:
            estimate = self.sketch.increment(mix64(int.from_bytes(self.spell(node)[-7:] + bytes([c]), "little") * 2654435761 + node))
            least = min(self.counters.linked, default=None)
            if least is None or estimate <= least - self.counters.threshold:
                return
            v = next(reversed(self.counters.linked[least]))
            if v == node:
                return
            self.counters.unlink(v)
            self.counters.freq[v] = self.counters.threshold
            self.counters.link(v)
            super()._insert(node, c)
            new = self.child.get(node << 8 | c)
            if new is not None:
                self.counters.unlink(new)
                self.counters.freq[new] = min(self.counters.cap, self.counters.threshold + estimate)
                self.counters.link(new)
            return
        super()._insert(node, c)


class Attractor:
    """k characters with counts. match: the longest prefix of a string that stands in them, of equals the
    one whose next character counts least; update: count the matched characters, and replace the
    mismatching one if it counts at most one, else count it down."""

    def __init__(self, k: int):
        self.chars, self.freq = bytearray(k), [0] * k

    def match(self, data: bytes, at: int) -> tuple[int, int]:
        """(place, length)."""
        low, high = 0, min(len(data) - at, len(self.chars) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if data[at : at + middle] in self.chars else (low, middle - 1)
        best, place, wanted = None, 0, data[at : at + low]
        found = self.chars.find(wanted)
        while found >= 0 and found + low < len(self.chars):
            if best is None or self.freq[found + low] < best:
                best, place = self.freq[found + low], found
            found = self.chars.find(wanted, found + 1)
        return (place, low) if best is not None else (len(self.chars) - 1 - low, low)

    def update(self, place: int, length: int, c: int | None) -> None:
        for i in range(place, place + length):
            self.freq[i] += 1
        if c is None:
            return
        i = place + length
        if self.freq[i] <= 1:
            self.chars[i], self.freq[i] = c, 1
        else:
            self.freq[i] -= 1


def membership(items: np.ndarray, k: int, kind: str = "mg") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stream of whole numbers below 2**61 - 1 read by a StringSummary (mg) or SketchStrings (cm) of k items:
    whether each is in the summary when it comes, whether it is after it was inserted, their order by number and place,
    and where in that order another number begins. What does not pass k different items is never evicted, so it needs
    no counters."""
    order = np.argsort(items, kind="stable")
    ordered = items[order]
    new = np.ones(len(items), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    before, after = np.ones(len(items), bool), np.ones(len(items), bool)
    before[order[new]] = False
    if len(items) > k and np.count_nonzero(new) > k:
        number = np.empty(len(items), np.int64)
        number[order] = np.cumsum(new) - 1
        here, there = (_mg_membership if kind == "mg" else _cm_membership)(number.tolist(), ordered[new], k)
        before, after = np.frombuffer(here, bool), np.frombuffer(there, bool)
    return before, after, order, new


def _mg_membership(items: list[int], distinct: np.ndarray, k: int) -> tuple[bytearray, bytearray]:
    """As StringSummary.insert does without a cap, an item standing for its slot."""
    before, after = bytearray(len(items)), bytearray(b"\1") * len(items)
    level: list = [0] * len(distinct)  # 0: not in the summary
    buckets: dict[int, dict[int, None]] = {}
    threshold, room = 0, k
    for i, x in enumerate(items):
        f = level[x]
        if f:
            before[i] = 1
            bucket = buckets[f]
            del bucket[x]
            if not bucket:
                del buckets[f]
            f += 1
        else:
            if room:
                room -= 1
            else:
                bucket = buckets.get(threshold)
                if bucket is None:
                    threshold += 1
                    after[i] = 0
                    continue
                level[bucket.popitem()[0]] = 0
                if not bucket:
                    del buckets[threshold]
            f = threshold + 1
        level[x] = f
        if f in buckets:
            buckets[f][x] = None
        else:
            buckets[f] = {x: None}
    return before, after


def _cm_membership(items: list[int], distinct: np.ndarray, k: int) -> tuple[bytearray, bytearray]:
    """As SketchStrings.insert does, with the cells of the sketch that are not zero."""
    before, after = bytearray(len(items)), bytearray(b"\1") * len(items)
    keys = mix64s(distinct.astype(np.uint64))
    rows, columns = SketchStrings.ROWS, SketchStrings.COLUMNS
    cells = [(mix64s(keys ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) & np.uint64(columns - 1)).astype(np.int64) + r * columns for r in range(rows)]
    used, cell = np.unique(np.concatenate(cells), return_inverse=True)
    one, two = cell.reshape(rows, -1).tolist()
    count = [0] * len(used)
    freq: list = [0] * len(distinct)  # 0: not in the filter
    entered = [0] * len(distinct)
    buckets: dict[int, dict[int, None]] = {}
    low, room = 1, k
    for i, x in enumerate(items):
        f = freq[x]
        if f:
            before[i] = 1
            bucket = buckets[f]
            del bucket[x]
            f += 1
            freq[x] = f
            if f in buckets:
                buckets[f][x] = None
            else:
                buckets[f] = {x: None}
            if not bucket:
                del buckets[f - 1]
                if low == f - 1:
                    low = f
            continue
        if room:
            room -= 1
            low = f = 1
        else:
            a, b = one[x], two[x]
            count[a] += 1
            count[b] += 1
            f = count[a] if count[a] < count[b] else count[b]
            if f <= low:
                after[i] = 0
                continue
            bucket = buckets[low]
            out = next(iter(bucket))
            del bucket[out]
            gained = freq[out] - entered[out]
            freq[out] = 0
            if gained > 0:
                count[one[out]] += gained
                count[two[out]] += gained
            entered[x] = f
        freq[x] = f
        if f in buckets:
            buckets[f][x] = None
        else:
            buckets[f] = {x: None}
        if not buckets[low]:
            del buckets[low]
            low = min(buckets)
    return before, after


def summarize(items: Iterable, k: int, max_freq: int = 1 << 30, kind: str = "mg") -> list[tuple]:
    """(item, count) of a stream in order; kind mg or cm."""
    summary = StringSummary(k, max_freq) if kind == "mg" else SketchStrings(k)
    for item in items:
        summary.insert(item)
    return summary.report()
