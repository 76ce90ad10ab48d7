"""Phrase parsings of one byte sequence, and their exact decoders.

A phrase is (kind, ref, src, len, lit): kind "pair" (dictionary phrase and a byte), "trie" (node of a bounded
dictionary), "lz" (copy len bytes from src back), "lit" (a byte), "end" (copy len bytes that end where phrase
ref ends, then a byte) or "match" (a length only). Unused fields are -1.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count
from typing import Any

import numpy as np

from phrasemill.functions.numbers import window_prints
from phrasemill.operators.suffix_index import NEAR, extension, inverse, near_extensions, shared_extensions, smaller_neighbours, suffix_array
from phrasemill.operators.summaries import Attractor, PrefixSummary, SketchPrefixes, membership

Phrase = tuple[str, int, int, int, int]


KINDS = ("lit", "lz", "trie", "pair", "end", "match")


@dataclass(frozen=True)
class Columns:
    """Phrases by columns: the number of the kind in KINDS, and the other fields."""

    kind: np.ndarray
    ref: np.ndarray
    src: np.ndarray
    len: np.ndarray
    lit: np.ndarray

    def phrases(self) -> list[Phrase]:
        kinds = map(KINDS.__getitem__, self.kind.tolist())
        return list(zip(kinds, self.ref.tolist(), self.src.tolist(), self.len.tolist(), self.lit.tolist(), strict=True))


def literal(c: int) -> Phrase:
    return ("lit", -1, -1, 1, c)


def copy(src: int, length: int) -> Phrase:
    return ("lz", -1, src, length, -1)


def append_copy(out: bytearray, src: int, length: int) -> None:
    """Copy from src back; where the copy overlaps itself the source repeats."""
    at = len(out) - src
    if src >= length:
        out += out[at : at + length]
    else:
        unit = bytes(out[at:])
        out += (unit * (length // src + 1))[:length]


def decode_copies(phrases: list[Phrase]) -> bytes:
    out = bytearray()
    for kind, _, src, length, lit in phrases:
        if kind == "lit":
            out.append(lit)
        else:
            append_copy(out, src, length)
    return bytes(out)


def encode_lz78(data: bytes) -> list[Phrase]:
    child: dict[int, int] = {}
    out: list[Phrase] = []
    node, length = 0, 0
    for c in data:
        nxt = child.get(node << 8 | c)
        if nxt is None:
            out.append(("pair", node, -1, length + 1, c))
            child[node << 8 | c] = len(out)
            node, length = 0, 0
        else:
            node, length = nxt, length + 1
    if node:
        out.append(("pair", node, -1, length, -1))
    return out


def decode_lz78(phrases: list[Phrase]) -> bytes:
    out, where = bytearray(), [(0, 0)]
    for _, ref, _, _, lit in phrases:
        start = len(out)
        a, b = where[ref]
        out += out[a:b]
        if lit >= 0:
            out.append(lit)
        where.append((start, len(out)))
    return bytes(out)


def _prefixes(summary: str, k: int, max_freq: int) -> PrefixSummary:
    return SketchPrefixes(k, max_freq) if summary == "cm" else PrefixSummary(k, max_freq)


def encode_topk_lz78(data: bytes, k: int = 1024, max_freq: int = 1024, summary: str = "mg") -> list[Phrase]:
    top = _prefixes(summary, k, max_freq)
    out: list[Phrase] = []
    state = top.EMPTY
    for c in data:
        nxt = top.extend(state, c)
        if nxt[2]:
            state = nxt
        else:
            out.append(("pair", state[0], -1, state[1] + 1, c))
            state = top.EMPTY
    if state[1]:
        out.append(("pair", state[0], -1, state[1], -1))
    return out


def decode_topk_lz78(phrases: list[Phrase], k: int = 1024, max_freq: int = 1024, summary: str = "mg") -> bytes:
    """Replays the dictionary: each phrase's bytes extend it as they did in the encoder."""
    top, out = _prefixes(summary, k, max_freq), bytearray()
    for _, ref, _, _, lit in phrases:
        text = top.spell(ref)
        if lit >= 0:
            text += bytes([lit])
        state = top.EMPTY
        for c in text:
            state = top.extend(state, c)
        out += text
    return bytes(out)


def factors(data: bytes, threshold: int = 2) -> list[Phrase]:
    """Greedy longest previous factors (overlap allowed): of the two nearest earlier suffixes the one
    before in order is preferred on a tie; shorter than the threshold gives literals."""
    before, after = smaller_neighbours(suffix_array(data))
    near_before, near_after = (near_extensions(data, np.array(x, np.int64)).tolist() for x in (before, after))
    out: list[Phrase] = []
    i, n = 0, len(data)
    while i < n:
        a, b = near_before[i], near_after[i]
        if a == NEAR:
            a += extension(data, i + NEAR, before[i] + NEAR)
        if b == NEAR:
            b += extension(data, i + NEAR, after[i] + NEAR)
        length, src = (a, before[i]) if a >= b else (b, after[i])
        if length >= threshold and length > 0:
            out.append(copy(i - src, length))
            i += length
        else:
            out.append(literal(data[i]))
            i += 1
    return out


def windows(data: bytes, window: int) -> list[bytes]:
    return [data[i : i + window] for i in range(0, len(data), window)]


def encode_blockwise(data: bytes, window: int = 1 << 20, threshold: int = 2) -> list[Phrase]:
    return [p for block in windows(data, window) for p in factors(block, threshold)]


def encode_topk_lz77(data: bytes, k: int = 1024, window: int = 1 << 16, max_freq: int = 1024, threshold: int = 2, summary: str = "mg") -> list[Phrase]:
    """At each place the dictionary's longest match competes with what is left of the current factor."""
    top, out = _prefixes(summary, k, max_freq), []
    for block in windows(data, window):
        todo = deque(factors(block, threshold))
        at = 0
        while at < len(block):
            kind, ref, src, length, lit = todo[0]
            node, depth = top.longest(block, at, len(block))
            if depth and depth >= length:
                phrase, size = ("trie", node, -1, depth, -1), depth
            elif kind == "lz" and length >= threshold:
                phrase, size = copy(src, length), length
            else:
                phrase, size = literal(block[at]), 1
            out.append(phrase)
            top.feed(block, at, at + size)
            at += size
            while size:
                kind, ref, src, length, lit = todo.popleft()
                if length > size:
                    todo.appendleft((kind, ref, src, length - size, lit))
                size -= min(size, length)
    return out


def decode_topk_lz77(phrases: list[Phrase], k: int = 1024, window: int = 1 << 16, max_freq: int = 1024, threshold: int = 2, summary: str = "mg") -> bytes:
    top, out = _prefixes(summary, k, max_freq), bytearray()
    for kind, ref, src, length, lit in phrases:
        start = len(out)
        if kind == "trie":
            out += top.spell(ref)
        elif kind == "lit":
            out.append(lit)
        else:
            append_copy(out, src, length)
        top.feed(out, start, len(out))
    return bytes(out)


class StaticTrie:
    """A frozen dictionary: nodes numbered in preorder, children by label."""

    def __init__(self, strings: list[bytes]):
        tree: dict = {}
        for s in strings:
            here = tree
            for c in s:
                here = here.setdefault(c, {})
        self.child: dict[int, int] = {}
        self.parent, self.label = [-1], [-1]
        stack = [(0, tree)]
        while stack:
            node, here = stack.pop()
            if node < 0:
                continue
            for c in sorted(here, reverse=True):
                stack.append((~(node << 8 | c), here[c]))
            while stack and stack[-1][0] < 0:
                code, below = stack.pop()
                parent, c = ~code >> 8, ~code & 255
                number = len(self.parent)
                self.parent.append(parent)
                self.label.append(c)
                self.child[parent << 8 | c] = number
                stack.append((number, below))
                break

    def spell(self, node: int) -> bytes:
        out = bytearray()
        while node > 0:
            out.append(self.label[node])
            node = self.parent[node]
        return bytes(reversed(out))

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        node, depth = 0, 0
        while at + depth < len(data):
            nxt = self.child.get(node << 8 | data[at + depth])
            if nxt is None:
                break
            node, depth = nxt, depth + 1
        return node, depth


def build_topk(data: bytes, k: int = 1024, max_freq: int = 1024) -> list[bytes]:
    """First pass: the strings of the bounded dictionary after reading the data phrase by phrase."""
    top = PrefixSummary(k, max_freq)
    state = top.EMPTY
    for c in data:
        state = top.extend(state, c)
        if not state[2]:
            state = top.EMPTY
    return [s for s, _ in top.strings()]


def parse_static(data: bytes, trie: StaticTrie) -> list[Phrase]:
    """Second pass: greedy longest matches in the frozen dictionary."""
    out, at = [], 0
    while at < len(data):
        node, depth = trie.longest(data, at)
        out.append(("trie", node, -1, depth, -1) if depth else literal(data[at]))
        at += depth or 1
    return out


def decode_static(phrases: list[Phrase], trie: StaticTrie) -> bytes:
    return b"".join(trie.spell(p[1]) if p[0] == "trie" else bytes([p[4]]) for p in phrases)


def encode_twopass(data: bytes, k: int = 1024, max_freq: int = 1024) -> list[Phrase]:
    """The dictionary's strings come first, as "match" phrases of a node's parent and label."""
    trie = StaticTrie(build_topk(data, k, max_freq))
    head = [("match", p, -1, 0, c) for p, c in zip(trie.parent[1:], trie.label[1:], strict=True)]
    return head + parse_static(data, trie)


def decode_twopass(phrases: list[Phrase], k: int = 1024, max_freq: int = 1024) -> bytes:
    nodes = [b""]
    out = bytearray()
    for kind, ref, _, _, lit in phrases:
        if kind == "match":
            nodes.append(nodes[ref] + bytes([lit]))
        else:
            out += nodes[ref] if kind == "trie" else bytes([lit])
    return bytes(out)


LITERALS = [literal(c) for c in range(256)]


def by_columns(phrases: list[Phrase]) -> Columns:
    kinds, *rest = zip(*phrases, strict=True) if phrases else [()] * 5
    return Columns(np.array([KINDS.index(k) for k in kinds], np.int8), *(np.array(x, np.int64) for x in rest))


def with_literals(data: bytes, kind: str, found: list[tuple[int, int, int]]) -> Columns:
    """Phrases (place, distance or reference, length) of one kind in order, and literals between them."""
    place, ref, length = np.array(found, np.int64).reshape(-1, 3).T
    begins = np.ones(len(data), bool)
    if len(found):
        inside = np.repeat(place - np.cumsum(length) + length, length) + np.arange(length.sum())
        begins[inside] = False
        begins[place] = True
    at = np.flatnonzero(begins)
    where = np.searchsorted(at, place)
    none = np.full(len(at), -1, np.int64)
    columns = Columns(np.zeros(len(at), np.int8), none, none.copy(), np.ones(len(at), np.int64), np.frombuffer(data, np.uint8)[at].astype(np.int32))
    columns.kind[where] = KINDS.index(kind)
    (columns.src if kind == "lz" else columns.ref)[where] = ref
    columns.len[where], columns.lit[where] = length, -1
    return columns


def copied(columns: Columns) -> bytes:
    """decode_copies by columns: literals are put in their places together, then the copies in order."""
    ends = np.cumsum(columns.len)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    plain = columns.lit >= 0
    out[ends[plain] - 1] = columns.lit[plain]
    text, rest = bytearray(out), ~plain
    for end, src, length in zip(ends[rest].tolist(), columns.src[rest].tolist(), columns.len[rest].tolist(), strict=True):
        at = end - length
        if src >= length:
            text[at:end] = text[at - src : end - src]
        else:
            text[at:end] = (text[at - src : at] * (length // src + 1))[:length]
    return bytes(text)


def same_bytes(data: bytes, at: np.ndarray, src: np.ndarray, size: int) -> np.ndarray:
    """Whether the size bytes from each place are those from its source."""
    views = np.ndarray((len(data) - size + 1,), f"V{size}", data, 0, (1,))
    return views[at] == views[src]


def psample_columns(data: bytes, exp_min: int = 2, exp_max: int = 6, k: int = 1024, sample_rsh: int = 1, min_dist: int = 0, summary: str = "mg") -> Columns:
    """For each length class, strings sampled by fingerprint enter a bounded summary; where a string in it
    was sampled before, the place may refer there. Longer classes choose first; of a class the reference that
    ends first is taken, and one of a shorter class only where it overlaps none of a longer. Every reference is
    verified by its bytes, so a fingerprint collision cannot spoil the text."""
    n = len(data)
    prints = window_prints(data, 65497, min(exp_max, max(0, n.bit_length() - 1)))
    chosen: list[tuple[int, int, int]] = []
    taken = bytearray(n)
    for e in range(min(exp_max, len(prints) - 1), exp_min - 1, -1):
        size = 1 << e
        mask = (size >> sample_rsh) - 1
        sampled = np.flatnonzero(prints[e] & np.uint64(mask & (1 << 64) - 1) == 0)
        items = prints[e][sampled]
        known, _, order, _ = membership(items, max(2, k >> (exp_max - e + 1)), summary)
        last = np.zeros(len(items), np.int64)  # what is in the summary was sampled where it stood last
        last[order[1:]] = sampled[order[:-1]]
        at, src = sampled[known], last[known]
        good = (at - src >= max(1, min_dist)) & same_bytes(data, at, src, size)
        free = 0
        for at, src in zip(at[good].tolist(), src[good].tolist(), strict=True):
            if at >= free:
                clash = taken.rfind(1, at, at + size)
                if clash < 0:
                    chosen.append((at, at - src, size))
                free = at + size if clash < 0 else clash + 1
                if clash < 0:
                    taken[at:free] = b"\1" * size
    return with_literals(data, "lz", sorted(chosen))


def encode_psample(data: bytes, *options: Any, **named: Any) -> list[Phrase]:
    return psample_columns(data, *options, **named).phrases()


ESCAPE = ord("$")  # fixed value of the byte format


def write_escaped(phrases: list[Phrase]) -> bytes:
    """Literals and copies as bytes: a literal is itself, but the escape byte is followed by a zero distance; a
    copy is the escape byte, its distance and its length, four bytes each."""
    out = bytearray()
    for kind, _, src, length, lit in phrases:
        if kind == "lz":
            out += bytes([ESCAPE]) + src.to_bytes(4, "little") + length.to_bytes(4, "little")
        else:
            out += bytes([ESCAPE, 0, 0, 0, 0]) if lit == ESCAPE else bytes([lit])
    return bytes(out)


def read_escaped(data: bytes) -> list[Phrase]:
    out, at = [], 0
    while at < len(data):
        if data[at] != ESCAPE:
            out.append(literal(data[at]))
            at += 1
            continue
        src = int.from_bytes(data[at + 1 : at + 5], "little")
        out.append(copy(src, int.from_bytes(data[at + 5 : at + 9], "little")) if src else literal(ESCAPE))
        at += 9 if src else 5
    return out


def encode_windowed_psample(data: bytes, window: int = 1 << 20, **options: int) -> list[Phrase]:
    """psample in windows: references stay inside a window, so a window is all that is held."""
    return [p for block in windows(data, window) for p in encode_psample(block, **options)]


def sample_columns(data: bytes, exp_min: int = 2, exp_max: int = 6, k: int = 1024, sample_exp: int = 3, min_dist: int = 0, minimizers: bool = False, summary: str = "mg") -> Columns:
    """The sequential sampler: at each place the longest class whose string is in the summary; sampling by
    the fingerprint's low bits or, with minimizers, by the least of the last 2**sample_exp fingerprints.
    A sampled place counts from its string's end on, so that a decoder could follow."""
    n = len(data)
    prints = window_prints(data, 65497, min(exp_max, max(0, n.bit_length() - 1)))
    sizes, sources = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for e in range(exp_min, min(exp_max, len(prints) - 1) + 1):  # a longer class takes the place of a shorter one
        size, own = 1 << e, prints[e]
        if minimizers:
            least = own.copy()
            for back in range(sample_exp):
                least[1 << back :] = np.minimum(least[1 << back :], least[: -(1 << back)])
            sampled = np.flatnonzero(own == least)
        else:
            sampled = np.flatnonzero(own & np.uint64((1 << sample_exp) - 1) == 0)
        _, taken, order, new = membership(own[sampled], k, summary)
        if minimizers:  # any place's string may have been sampled before; most are told apart by 14 bits
            known = own[sampled[order[new]]]
            low, kept = own & np.uint64((1 << 14) - 1), sampled[taken][::-1]
            first = np.full(1 << 14, n, np.int32)
            first[low[kept]] = kept  # the last that is written is the first in the text
            asked = np.flatnonzero(first[low] <= np.arange(-size, len(own) - size, dtype=np.int32))
            number = np.minimum(np.searchsorted(known, own[asked]), len(known) - 1)
            there = known[number] == own[asked]
            asked, number = asked[there], number[there]
            marks = (np.cumsum(new) * (2 * n) + sampled[order] - n)[taken[order]]
        else:
            once = new & np.append(new[1:], True)[: len(new)]
            asked, number = sampled[order][~once], np.cumsum(new)[~once]
            marks = (number * (2 * n) + asked + n)[taken[order][~once]]
        if not len(marks):
            continue
        found = np.searchsorted(marks, number * (2 * n) + asked + n - size, side="right") - 1  # the last that ended by then
        src = marks[found] - number * (2 * n) - n
        there = (found >= 0) & (src >= 0)
        asked, src = asked[there], src[there]
        there = (asked - src >= max(1, min_dist)) & same_bytes(data, asked, src, size)
        sizes[asked[there]], sources[asked[there]] = size, src[there]
    hits = np.flatnonzero(sizes)
    copies, free = [], 0
    for at, src, size in zip(hits.tolist(), sources[hits].tolist(), sizes[hits].tolist(), strict=True):
        if at >= free:
            copies.append((at, at - src, size))
            free = at + size
    return with_literals(data, "lz", copies)


def encode_sample(data: bytes, *options: Any, **named: Any) -> list[Phrase]:
    return sample_columns(data, *options, **named).phrases()


def encode_attract(data: bytes, k: int = 256) -> list[Phrase]:
    """Match lengths against k attractor characters; a statistics-only parsing."""
    own, out, at = Attractor(k), [], 0
    while at < len(data):
        place, length = own.match(data, at)
        c = data[at + length] if at + length < len(data) else None
        own.update(place, length, c)
        out.append(("match", place, -1, length + (c is not None), -1 if c is None else c))
        at += length + 1
    return out


def encode_lzend(data: bytes, longest: int = 1 << 30) -> list[Phrase]:
    """The longest prefix of the rest that ends where an earlier phrase ends, and a byte. In the reversed
    text's suffix order, phrase ends are marked; the nearest marked neighbours decide."""
    n = len(data)
    back = data[::-1]
    rank = inverse(suffix_array(back)).tolist()
    before, after = smaller_neighbours(suffix_array(data))
    marked: list[tuple[int, int]] = []  # (rank of the reversed prefix, number of the phrase that ends there)
    ends: list[int] = []
    out: list[Phrase] = []
    at = 0
    while at < n:
        reach = max(extension(data, at, p) if p >= 0 else 0 for p in (before[at], after[at]))
        best = (0, -1)
        for length in range(min(reach, n - at - 1, longest - 1), 0, -1):
            place = n - (at + length)
            i = bisect_left(marked, (rank[place], -1))
            for neighbour in marked[max(0, i - 1) : i + 1]:
                if extension(back, place, n - ends[neighbour[1]], length) >= length:
                    best = (length, neighbour[1])
                    break
            if best[0]:
                break
        length, ref = best
        out.append(("end", ref, -1, length + 1, data[at + length]))
        at += length + 1
        ends.append(at)
        if at < n:
            insort(marked, (rank[n - at], len(ends) - 1))
    return out


def decode_lzend(phrases: list[Phrase]) -> bytes:
    out, ends = bytearray(), []
    for _, ref, _, length, lit in phrases:
        if length > 1:
            end = ends[ref]
            out += out[end - length + 1 : end]
        out.append(lit)
        ends.append(len(out))
    return bytes(out)


def encode_lzend_blockwise(data: bytes, window: int = 1 << 16) -> list[Phrase]:
    """LZ-End in each window; references count phrases of the whole sequence."""
    out: list[Phrase] = []
    for block in windows(data, window):
        base = len(out)
        out += [(kind, ref + base if ref >= 0 else -1, src, length, lit) for kind, ref, src, length, lit in encode_lzend(block)]
    return out


def lzend_kk_columns(data: bytes, window: int = 1 << 16, prefer_local: bool = False) -> Columns:
    """LZ-End online, by Kempa and Kosolobov's rule: with every byte the last two phrases are merged if an
    earlier phrase ends with their text, else the last one is extended if one ends with its, else the byte begins a
    phrase. Phrases are at most ``window`` bytes long. Sources are looked for among the phrases of the last
    blocks (local) and among the older ones, which of them first is told by prefer_local: the phrases are the same,
    their links differ."""
    n = len(data)
    order = suffix_array(data[::-1])
    ranks = inverse(order)
    rank = ranks[::-1].tolist()  # rank[i - 1]: of the bytes before place i, read backward
    shared = shared_extensions(data[::-1], order)[ranks][::-1].tolist()  # with any other place's, up to NEAR
    place = [n, *(n - order).tolist()]  # by rank, from 1 on
    local: list[int] = []  # ranks of the ends of the phrases but the last two
    old: list[int] = []
    number: dict[int, int] = {}  # of the phrase that ends at a place
    ends: list[int] = []
    lens: list[int] = []
    links: list[int] = []
    first = 0  # of the local phrases

    def drop(marks: list[int], r: int) -> None:
        del marks[bisect_left(marks, r)]

    for m in range(n):
        if m % window == 0 and m >= 2 * window:  # the window slides by a block
            begin = m - 2 * window
            while first < len(ends) - 2 and ends[first] <= begin:
                r = rank[ends[first] - 1]
                drop(local, r)
                insort(old, r)
                first += 1
        z = len(ends)
        link, size = -1, 1
        if z:
            last, near = lens[-1], shared[m - 1]
            if last < window and (near >= last or near == NEAR):
                both = last + lens[-2] if z > 1 else window
                merge = both < window and (near >= both or near == NEAR)
                text, longer = data[m - last : m], data[m - both : m] if merge else b""
                r = rank[m - 1]
                found = -1
                for marks in (local, old) if prefer_local else (old, local):
                    i = bisect_left(marks, r)
                    for s in marks[i - 1 : i + 1] if i else marks[:1]:
                        end = place[s + 1]
                        if end >= last and data[end - last : end] == text:
                            if found < 0:
                                found = end
                            if merge and end >= both and data[end - both : end] == longer:
                                link = number[end]
                                break
                    if link >= 0 or found >= 0 and not merge:
                        break
                if link >= 0:
                    size = both + 1
                    for end in ends[-2:]:
                        del number[end]
                    del ends[-2:], links[-2:], lens[-2:]
                    if z > 2:
                        if z - 3 < first:
                            first -= 1
                            drop(old, rank[ends[-1] - 1])
                        else:
                            drop(local, rank[ends[-1] - 1])
                else:
                    if z > 1 and (found < 0 or prefer_local):
                        end = ends[-2]
                        if end >= last and data[end - last : end] == text:
                            found = end
                    if found >= 0:
                        link, size = number[found], last + 1
                        del number[ends.pop()], links[-1], lens[-1]
            if link < 0 and z > 1:
                insort(local, rank[ends[-2] - 1])
        number[m + 1] = len(ends)
        ends.append(m + 1)
        lens.append(size)
        links.append(link)
    lits = np.frombuffer(data, np.uint8)[np.array(ends, np.int64) - 1].astype(np.int32)
    kind, src = np.full(len(ends), KINDS.index("end"), np.int8), np.full(len(ends), -1, np.int64)
    return Columns(kind, np.array(links, np.int64), src, np.array(lens, np.int64), lits)


def encode_lzend_kk(data: bytes, window: int = 1 << 16, prefer_local: bool = False) -> list[Phrase]:
    return lzend_kk_columns(data, window, prefer_local).phrases()


def end_copied(columns: Columns) -> bytes:
    """decode_lzend by columns."""
    out, ends = bytearray(), np.cumsum(columns.len).tolist()
    for ref, length, lit in zip(columns.ref.tolist(), columns.len.tolist(), columns.lit.tolist(), strict=True):
        if length > 1:
            end = ends[ref]
            out += out[end - length + 1 : end]
        out.append(lit)
    return bytes(out)


def encode_topk_lzend(data: bytes, k: int = 1024, window: int = 1 << 14, max_freq: int = 1024) -> list[Phrase]:
    """Windowed LZ-End phrases compete with a bounded dictionary of frequent prefixes: a match there that is as
    long gives a dictionary phrase, whose end is a phrase end too. Sources are the phrase ends of the last two
    windows, found as nearest marked neighbours in the reversed text's suffix order, at any length."""
    n = len(data)
    back = data[::-1]
    rank = inverse(suffix_array(back)).tolist()
    before, after = smaller_neighbours(suffix_array(data))
    top, out, at = PrefixSummary(k, max_freq), [], 0
    marked: list[tuple[int, int]] = []
    ends: list[int] = []
    first = 0
    while at < n:
        node, depth = top.longest(data, at, n - 1)
        reach = max(extension(data, at, p) if p >= 0 else 0 for p in (before[at], after[at]))
        best, ref = 0, -1
        for length in range(min(reach, n - at - 1), depth, -1):
            place = n - (at + length)
            i = bisect_left(marked, (rank[place], -1))
            for _, phrase in marked[max(0, i - 1) : i + 1]:
                if extension(back, place, n - ends[phrase], length) >= length:
                    best, ref = length, phrase
                    break
            if best:
                break
        size = (best or depth) + 1
        out.append(("end", ref, -1, size, data[at + size - 1]) if best else ("pair", node, -1, size, data[at + size - 1]))
        top.feed(data, at, at + size)
        at += size
        ends.append(at)
        if at < n:
            insort(marked, (rank[n - at], len(ends) - 1))
        while ends[first] < at - 2 * window:
            marked.remove((rank[n - ends[first]], first))
            first += 1
    return out


def decode_topk_lzend(phrases: list[Phrase], k: int = 1024, window: int = 1 << 14, max_freq: int = 1024) -> bytes:
    top, out, ends = PrefixSummary(k, max_freq), bytearray(), []
    for kind, ref, _, length, lit in phrases:
        start = len(out)
        if kind == "pair":
            out += top.spell(ref)
        elif length > 1:
            out += out[ends[ref] - length + 1 : ends[ref]]
        out.append(lit)
        top.feed(out, start, len(out))
        ends.append(len(out))
    return bytes(out)


class ReversedWindows:
    """A bounded dictionary of reversed strings. A node's suffix link leads to the string without its first
    byte, and a Weiner link back: for text read from left to right, one more byte is one Weiner link. A node
    remembers where its string ended last."""

    def __init__(self, k: int, max_freq: int):
        self.top = PrefixSummary(k, max_freq, self._insert, self._delete)
        self.suffix: dict[int, int] = {}
        self.links: dict[int, dict[int, int]] = {0: {}}
        self.first: dict[int, int] = {}  # the first byte of a node's string
        self.ended: dict[int, int] = {}

    def _join(self, shorter: int, longer: int) -> None:
        self.suffix[longer] = shorter
        self.links[shorter][self.first[longer]] = longer

    def _insert(self, v: int) -> None:
        up, c, child = self.top.parent[v], self.top.label[v], self.top.child
        self.first[v] = self.first[up] if up else c
        self.links[v] = {}
        self.ended.pop(v, None)
        if not up:
            self._join(0, v)
        elif up in self.suffix:
            shorter = child.get(self.suffix[up] << 8 | c)
            if shorter is not None:
                self._join(shorter, v)
        for u in list(self.links[up].values()):
            longer = child.get(u << 8 | c)
            if longer is not None and longer not in self.suffix:
                self._join(v, longer)

    def _delete(self, v: int) -> None:
        if v in self.suffix:
            del self.links[self.suffix.pop(v)][self.first[v]]
        for u in self.links.pop(v).values():
            del self.suffix[u]
        self.ended.pop(v, None)

    def feed(self, data: bytes, at: int, window: int, ascend: bool) -> None:
        """The window of bytes that ends at this place, read backward."""
        seen = self.top.feed(data, at, max(-1, at - window), -1)
        for v in seen if ascend else seen[-1:]:
            if v in self.links:  # it may have been recycled on the way
                self.ended[v] = at


def weiner_columns(data: bytes, k: int = 1024, window: int = 8, threshold: int = 2, max_freq: int = 1024, ascend: bool = True) -> Columns:
    """A factor goes on as long as there is a Weiner link by the next byte to a string that ended before; it is
    copied from there. Every place's window enters the dictionary reversed. ascend: all strings on the way
    take the place, else the longest only. The Weiner link of the factor's node by the next byte leads to the node at the
    next depth on the way of the next place's window, for the window before kept the factor's node; so the links that
    ReversedWindows has need not be stored."""
    top = PrefixSummary(k, max_freq)
    ended = [-1] * top.k  # where a node's string ended last
    ways = top.windows(data[::-1], range(len(data) - 1, -1, -1), window, ended)
    copies: list[tuple[int, int, int]] = []
    begin, depth, src = 0, 0, -1

    def emit(end: int) -> None:
        size = end - begin
        start = src - size + 1
        if size >= threshold and 0 <= start < begin and data[start : start + size] == data[begin:end]:
            copies.append((begin, begin - start, size))

    for at, way in enumerate(ways):
        if depth < len(way) and at - begin < window and ended[way[depth]] >= 0:
            src = ended[way[depth]]
            depth += 1
        else:
            emit(at)
            begin = at
            depth, src = (1, ended[way[0]]) if way else (0, -1)
        if ascend:
            for v in way:
                ended[v] = at
        elif way:
            ended[way[-1]] = at
    emit(len(data))
    return with_literals(data, "lz", copies)


def encode_weiner(data: bytes, *options: Any, **named: Any) -> list[Phrase]:
    return weiner_columns(data, *options, **named).phrases()


def selective_columns(data: bytes, k: int = 1024, window: int = 8, max_freq: int = 1024) -> Columns:
    """Selective emission: the dictionary learns strings of up to ``window`` bytes from every place; a
    phrase is a dictionary node if the match is longer than one byte, else a literal."""
    top, found, at, fed = PrefixSummary(k, max_freq), [], 0, 0
    ways = top.windows(data, count(), window)
    get = top.child.get
    while at < len(data):
        node = depth = 0
        for c in data[at : at + window]:
            nxt = get(node << 8 | c)
            if nxt is None:
                break
            node = nxt
            depth += 1
        if depth > 1:
            found.append((at, node, depth))
            at += depth
        else:
            at += 1
        while fed + window <= at:
            next(ways)
            fed += 1
    return with_literals(data, "trie", found)


def encode_selective(data: bytes, *options: Any, **named: Any) -> list[Phrase]:
    return selective_columns(data, *options, **named).phrases()


def selected(columns: Columns, k: int = 1024, window: int = 8, max_freq: int = 1024) -> bytes:
    top, out, fed = PrefixSummary(k, max_freq), bytearray(), 0
    ways = top.windows(out, count(), window)
    for ref, lit in zip(columns.ref.tolist(), columns.lit.tolist(), strict=True):
        if lit < 0:
            out += top.spell(ref)
        else:
            out.append(lit)
        while fed + window <= len(out):
            next(ways)
            fed += 1
    return bytes(out)


def decode_selective(phrases: list[Phrase], k: int = 1024, window: int = 8, max_freq: int = 1024) -> bytes:
    return selected(by_columns(phrases), k, window, max_freq)


def encode_deflate(data: bytes) -> list[Phrase]:
    return [("match", -1, -1, len(data), c) for c in zlib.compress(data, 9)] if data else []


def decode_deflate(phrases: list[Phrase]) -> bytes:
    return zlib.decompress(bytes(p[4] for p in phrases)) if phrases else b""


@dataclass(frozen=True)
class Parser:
    """encode(data, **options) -> phrases, decode(phrases, **options) -> data (None: statistics only). columns, back: the
    same by Columns, of parsers that work on them."""

    encode: Callable[..., list[Phrase]]
    decode: Callable[..., bytes] | None
    columns: Callable[..., Columns] | None = None
    back: Callable[..., bytes] | None = None


def _plain(decode: Callable[[Any], bytes]) -> Callable[..., bytes]:
    return lambda phrases, **_: decode(phrases)


PARSERS: dict[str, Parser] = {
    "lz78": Parser(encode_lz78, _plain(decode_lz78)),
    "topk_lz78": Parser(encode_topk_lz78, decode_topk_lz78),
    "lz77": Parser(factors, _plain(decode_copies)),
    "lpfs": Parser(factors, _plain(decode_copies)),
    "blockwise_lz77": Parser(encode_blockwise, _plain(decode_copies)),
    "topk_lz77": Parser(encode_topk_lz77, decode_topk_lz77),
    "twopass": Parser(encode_twopass, decode_twopass),
    "psample": Parser(encode_psample, _plain(decode_copies), psample_columns, _plain(copied)),
    "windowed_psample": Parser(encode_windowed_psample, _plain(decode_copies)),
    "sample": Parser(encode_sample, _plain(decode_copies), sample_columns, _plain(copied)),
    "attract": Parser(encode_attract, None),
    "lzend": Parser(encode_lzend, _plain(decode_lzend)),
    "lzend_kk": Parser(encode_lzend_kk, _plain(decode_lzend), lzend_kk_columns, _plain(end_copied)),
    "lzend_kkl": Parser(lambda data, window=1 << 16: encode_lzend_kk(data, window, prefer_local=True), _plain(decode_lzend), lambda data, window=1 << 16: lzend_kk_columns(data, window, prefer_local=True), _plain(end_copied)),
    "lzend_blockwise": Parser(encode_lzend_blockwise, _plain(decode_lzend)),
    "topk_lzend": Parser(encode_topk_lzend, decode_topk_lzend),
    "topk_sel": Parser(encode_selective, decode_selective, selective_columns, selected),
    "topk_weiner": Parser(encode_weiner, _plain(decode_copies), weiner_columns, _plain(copied)),
    "topk_weiner_fast": Parser(lambda data, **o: encode_weiner(data, ascend=False, **o), _plain(decode_copies), lambda data, **o: weiner_columns(data, ascend=False, **o), _plain(copied)),
    "gzip9": Parser(encode_deflate, _plain(decode_deflate)),
}
