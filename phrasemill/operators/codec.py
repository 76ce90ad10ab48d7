"""Entropy coding of token streams in blocks, and exact decoders.

A stream is a list of (type, value). A block holds at most block_size tokens over all types, in order. Each
block states, for every type it holds, the coder's header, then the tokens' codes in order of the stream.
Coders: "binary" (fixed width over the block's range), "huffman" (canonical, per block), "rans" (range
asymmetric numeral system with 14 probability bits, values below 256), "vitter" (adaptive Huffman).
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

PROB_BITS = 14
LOW = 1 << 23


class BitWriter:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, width: int) -> None:
        if width:
            self.parts.append(format(value, f"0{width}b"))

    def put_bits(self, bits: str) -> None:
        self.parts.append(bits)

    def put_delta(self, value: int) -> None:
        """Elias delta of a positive number."""
        n = value.bit_length()
        m = n.bit_length()
        self.put_bits("0" * (m - 1) + format(n, "b") + format(value, "b")[1:])

    def done(self) -> bytes:
        bits = "".join(self.parts)
        bits += "0" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big") if bits else b""

    def size(self) -> int:
        return sum(map(len, self.parts))


class BitReader:
    def __init__(self, data: bytes):
        self.bits = format(int.from_bytes(data, "big"), f"0{len(data) * 8}b") if data else ""
        self.at = 0

    def get(self, width: int) -> int:
        if not width:
            return 0
        value = int(self.bits[self.at : self.at + width], 2)
        self.at += width
        return value

    def bit(self) -> str:
        self.at += 1
        return self.bits[self.at - 1]

    def get_delta(self) -> int:
        m = self.bits.index("1", self.at) - self.at + 1
        self.at += m - 1
        n = self.get(m)
        return 1 << (n - 1) | self.get(n - 1)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; a lone symbol gets one bit."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    symbols = sorted(counts)
    heap = [(counts[s], s, i) for i, s in enumerate(symbols)]
    heapq.heapify(heap)
    above = [0] * (2 * len(symbols) - 1)
    for node in range(len(symbols), len(above)):
        a, low = heapq.heappop(heap), heap[0]
        above[a[2]] = above[low[2]] = node
        heapq.heapreplace(heap, (a[0] + low[0], min(a[1], low[1]), node))
    depth = [0] * len(above)
    for node in range(len(above) - 2, -1, -1):
        depth[node] = depth[above[node]] + 1
    return dict(zip(symbols, depth))


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    codes, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        codes[symbol] = format(code, f"0{length}b")
        code, last = code + 1, length
    return codes


def huffman_bits(counts: dict[int, int]) -> int:
    """Bits of all codes together."""
    lengths = code_lengths(counts) if counts else {}
    return sum(n * lengths[s] for s, n in counts.items())


def normalize(counts: dict[int, int], total: int = 1 << PROB_BITS) -> dict[int, int]:
    """Frequencies that sum to total, at least one each; rounding is taken from or given to the largest."""
    n = sum(counts.values())
    out = {s: max(1, c * total // n) for s, c in counts.items()}
    order = sorted(out, key=lambda s: (-counts[s], s))
    left = total - sum(out.values())
    i = 0
    while left:
        s = order[i % len(order)]
        step = left if left > 0 else -min(-left, out[s] - 1)
        out[s] += step
        left -= step
        i += 1
    return out


def _starts(freq: dict[int, int]) -> dict[int, int]:
    out, at = {}, 0
    for s in sorted(freq):
        out[s] = at
        at += freq[s]
    return out


def rans_encode(values: list[int]) -> bytes:
    """Header (symbols and frequencies in Elias delta codes), final state, and renormalization bytes."""
    head = BitWriter()
    freq = normalize(Counter(values)) if values else {}
    head.put_delta(len(values) + 1)
    head.put_delta(len(freq) + 1)
    last = -1
    for s in sorted(freq):
        head.put_delta(s - last)
        head.put_delta(freq[s])
        last = s
    start, x, out = _starts(freq), LOW, bytearray()
    for s in reversed(values):
        f = freq[s]
        while x >= (LOW >> PROB_BITS << 8) * f:
            out.append(x & 255)
            x >>= 8
        x = (x // f << PROB_BITS) + x % f + start[s]
    h = head.done()
    return len(h).to_bytes(4, "little") + h + x.to_bytes(4, "little") + bytes(reversed(out))


def rans_decode(data: bytes) -> list[int]:
    size = int.from_bytes(data[:4], "little")
    head = BitReader(data[4 : 4 + size])
    count, symbols = head.get_delta() - 1, head.get_delta() - 1
    freq, last = {}, -1
    for _ in range(symbols):
        last += head.get_delta()
        freq[last] = head.get_delta()
    start = _starts(freq)
    slot = [0] * (1 << PROB_BITS)
    for s, a in start.items():
        slot[a : a + freq[s]] = [s] * freq[s]
    x, at, out = int.from_bytes(data[4 + size : 8 + size], "little"), 8 + size, []
    for _ in range(count):
        s = slot[x & ((1 << PROB_BITS) - 1)]
        x = freq[s] * (x >> PROB_BITS) + (x & ((1 << PROB_BITS) - 1)) - start[s]
        while x < LOW and at < len(data):
            x = x << 8 | data[at]
            at += 1
        out.append(s)
    return out


class AdaptiveHuffman:
    """A dynamic Huffman tree: nodes in a list by falling weight (the sibling property); a node whose weight
    is to grow first changes places with the first of its weight. New symbols follow the escape leaf."""

    def __init__(self, width: int = 8):
        self.width = width
        self.nodes = [{"weight": 0, "parent": None, "symbol": None, "kids": None}]
        self.escape = self.nodes[0]
        self.leaf: dict[int, dict] = {}
        self.escape["index"] = 0

    def _path(self, node: dict) -> str:
        bits = []
        while node["parent"] is not None:
            bits.append("1" if node["parent"]["kids"][1] is node else "0")
            node = node["parent"]
        return "".join(reversed(bits))

    def encode(self, symbol: int) -> str:
        known = self.leaf.get(symbol)
        bits = self._path(known) if known else self._path(self.escape) + format(symbol, f"0{self.width}b")
        self.update(symbol)
        return bits

    def decode(self, reader: BitReader) -> int:
        node = self.nodes[0]
        while node["kids"] is not None:
            node = node["kids"][reader.bit() == "1"]
        symbol = reader.get(self.width) if node is self.escape else node["symbol"]
        self.update(symbol)
        return symbol

    def _swap(self, a: dict, b: dict) -> None:
        for node in (a, b):
            node["slot"] = 0 if node["parent"]["kids"][0] is node else 1
        a["parent"]["kids"][a["slot"]], b["parent"]["kids"][b["slot"]] = b, a
        a["parent"], b["parent"] = b["parent"], a["parent"]
        self.nodes[a["index"]], self.nodes[b["index"]] = b, a
        a["index"], b["index"] = b["index"], a["index"]

    def update(self, symbol: int) -> None:
        node = self.leaf.get(symbol)
        if node is None:
            inner = self.escape
            node = {"weight": 0, "parent": inner, "symbol": symbol, "kids": None, "index": len(self.nodes)}
            escape = {"weight": 0, "parent": inner, "symbol": None, "kids": None, "index": len(self.nodes) + 1}
            inner["kids"] = [escape, node]
            self.nodes += [node, escape]
            self.escape, self.leaf[symbol] = escape, node
        while node is not None:
            first = node["index"]
            while first and self.nodes[first - 1]["weight"] == node["weight"]:
                first -= 1
            leader = self.nodes[first]
            if leader is not node and leader is not node["parent"] and leader["parent"] is not None:
                above, is_above = node, False
                while above is not None:
                    is_above |= above is leader
                    above = above["parent"]
                if not is_above:
                    self._swap(node, leader)
            node["weight"] += 1
            node = node["parent"]


def encode_adaptive(values: list[int], width: int = 8) -> bytes:
    tree, out = AdaptiveHuffman(width), BitWriter()
    for v in values:
        out.put_bits(tree.encode(v))
    return len(values).to_bytes(4, "little") + out.done()


def decode_adaptive(data: bytes, width: int = 8) -> list[int]:
    tree, reader = AdaptiveHuffman(width), BitReader(data[4:])
    return [tree.decode(reader) for _ in range(int.from_bytes(data[:4], "little"))]


def encode_block(tokens: list[tuple[int, int]], coders: dict[int, str]) -> tuple[bytes, dict[int, tuple[int, int, int]]]:
    """The block's bytes, and for each type (tokens, header bits, data bits)."""
    out, stats = BitWriter(), {}
    out.put(len(tokens), 32)
    codes: dict[int, tuple] = {}
    for t in sorted(coders):
        values = [v for kind, v in tokens if kind == t]
        before = out.size()
        out.put(bool(values), 1)
        if values:
            if coders[t] == "huffman":
                lengths = code_lengths(Counter(values))
                out.put_delta(len(lengths))
                last = -1
                for s in sorted(lengths):
                    out.put_delta(s - last)
                    out.put_delta(lengths[s])
                    last = s
                codes[t] = ("huffman", canonical(lengths))
            else:
                low, width = min(values), (max(values) - min(values)).bit_length()
                out.put_delta(low + 1)
                out.put_delta(width + 1)
                codes[t] = ("binary", low, width)
        stats[t] = (len(values), out.size() - before, 0)
    for t, v in tokens:
        code = codes[t]
        before = len(code[1][v]) if code[0] == "huffman" else code[2]
        if code[0] == "huffman":
            out.put_bits(code[1][v])
        else:
            out.put(v - code[1], code[2])
        n, head, data = stats[t]
        stats[t] = (n, head, data + before)
    return out.done(), stats


def _delta_bits(value: int) -> int:
    n = value.bit_length()
    return n + 2 * n.bit_length() - 2


def encode_values(values: np.ndarray) -> tuple[str, bytes]:
    """The shorter of what encode_block makes of one type's numbers by "binary" and by "huffman", and which it is (the
    first, if neither is shorter). Huffman codes are made only where their header and the entropy leave room for them."""
    n, low = len(values), int(values.min())
    width = (int(values.max()) - low).bit_length()
    head = 32 + 1
    bits = head + _delta_bits(low + 1) + _delta_bits(width + 1) + n * width
    out = BitWriter()
    out.put(n, 32)
    out.put(1, 1)
    if width:
        symbols, counts = np.unique(values, return_counts=True)
        gaps = np.diff(symbols, prepend=-1)
        digits = np.frexp(gaps.astype(np.float64))[1]  # numbers below 2**53
        head += _delta_bits(len(symbols)) + int((digits + 2 * np.frexp(digits.astype(np.float64))[1] - 2).sum())
        entropy = n * np.log2(n) - float((counts * np.log2(counts)).sum())
        if (head + len(symbols) + int(entropy - 0.5) + 7) // 8 < (bits + 7) // 8:
            known = symbols.tolist()
            lengths = code_lengths(dict(zip(known, counts.tolist(), strict=True)))
            head += sum(_delta_bits(x) for x in lengths.values())
            if (head + sum(lengths[s] * c for s, c in zip(known, counts.tolist(), strict=True)) + 7) // 8 < (bits + 7) // 8:
                out.put_delta(len(known))
                for s, gap in zip(known, gaps.tolist(), strict=True):
                    out.put_delta(gap)
                    out.put_delta(lengths[s])
                out.put_bits("".join(map(canonical(lengths).__getitem__, values.tolist())))
                return "huffman", out.done()
    out.put_delta(low + 1)
    out.put_delta(width + 1)
    rest = (values - low).astype(">u8").view(np.uint8).reshape(n, 8)
    kept = -(-width // 8)
    digits = np.unpackbits(rest[:, 8 - kept :], axis=1)[:, 8 * kept - width :]
    start = np.frombuffer("".join(out.parts).encode(), np.uint8) - ord("0")
    return "binary", np.packbits(np.concatenate([start, digits.ravel()])).tobytes()


def decode_block(data: bytes, coders: dict[int, str], order) -> list[tuple[int, int]]:
    """order(tokens so far) names the type of the next token, as the format's grammar does."""
    reader = BitReader(data)
    count, codes = reader.get(32), {}
    for t in sorted(coders):
        if not reader.get(1):
            continue
        if coders[t] == "huffman":
            symbols, lengths, last = reader.get_delta(), {}, -1
            for _ in range(symbols):
                last += reader.get_delta()
                lengths[last] = reader.get_delta()
            codes[t] = ("huffman", {c: s for s, c in canonical(lengths).items()})
        else:
            codes[t] = ("binary", reader.get_delta() - 1, reader.get_delta() - 1)
    out: list[tuple[int, int]] = []
    for _ in range(count):
        t = order(out)
        code = codes[t]
        if code[0] == "huffman":
            bits = reader.bit()
            while bits not in code[1]:
                bits += reader.bit()
            out.append((t, code[1][bits]))
        else:
            out.append((t, code[1] + reader.get(code[2])))
    return out


def write_uint(value: int, size: int) -> bytes:
    return value.to_bytes(size, "little")


def read_uint(data: bytes, size: int) -> int:
    return int.from_bytes(data[:size], "little")


def encode_trie(parent: list[int], label: list[int]) -> tuple[str, bytes]:
    """A trie numbered in preorder as balanced parentheses and labels."""
    out, open_, labels = [], [0], bytearray()
    for node in range(1, len(parent)):
        while open_[-1] != parent[node]:
            out.append(")")
            open_.pop()
        out.append("(")
        labels.append(label[node])
        open_.append(node)
    out.append(")" * (len(open_) - 1))
    return "".join(out), bytes(labels)


def decode_trie(shape: str, labels: bytes) -> tuple[list[int], list[int]]:
    parent, label, open_ = [-1], [-1], [0]
    for c in shape:
        if c == "(":
            parent.append(open_[-1])
            label.append(labels[len(label) - 1])
            open_.append(len(parent) - 1)
        else:
            open_.pop()
    return parent, label
