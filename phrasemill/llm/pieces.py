"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a text falls apart where no piece reaches across: before a run of word marks, and around
line ends. The forward sums of each distinct part are taken once for a batch of rows, for all new parts at a
time; backward sampling then walks all parts of the batch together. Step s of part j of a row takes its
uniform number from a hash of (seed, row key, j, s), so a row's segmentation depends on nothing but its key
and text.

The model stores merge ranks, no probabilities: a piece of rank r weighs (r + 10) ** -theta. A character
without a piece is spelt in byte pieces. Spaces are written as word marks after one at the start, as the
model does; a word mark that the text itself holds is spelt in bytes, so decoding gives the text back.

Defined results: a null text is empty and has the one leading mark; an empty text likewise; a null key is
a key of its own; rows that repeat key and text get equal segmentations; a very long text is encoded whole,
CHUNK_WORDS parts at a time, and a very long part (no space) in time linear in its length; an empty table
gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK, OWN_MARK = "▁", "\udc81"  # the second stands for a word mark of the text itself
SEED, THETA = 1, 1.0
CHUNK_WORDS = 100_000  # parts of a text that are sampled at a time
KEPT_NODES = 4_000_000  # of the lattices that a task keeps from one batch to the next, about
FALLBACK = 1 << 24  # plus the character: an edge that is spelt in bytes


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_seeds(key: int | None, start: int, count: int, seed: int = SEED) -> np.ndarray:
    """The seeds of parts start.. of the row of this key."""
    base = int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")
    return mixed(np.arange(start, start + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base))


def uniforms(seeds: np.ndarray, step: int) -> np.ndarray:
    """A uniform number in [0, 1) for a step of each seed."""
    return (mixed(seeds + np.uint64((step * 0xD1342543DE82EF95) % (1 << 64))) >> np.uint64(11)) / float(1 << 53)


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.view(), np.empty(max(need * 3 // 2 - self.size, len(values)), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Lattices:
    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.log_weight = np.full(size, -theta * math.log(size + 10))
        self.log_weight[plain] = [-theta * math.log(rank[i] + 10) for i in plain]
        self.byte_log = float(-theta * math.log(size + 10))
        self.bytes = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.pieces = {names[i]: i for i in plain}
        multi = [names[i] for i in plain if len(names[i]) > 1]
        if any(MARK in n.lstrip(MARK) for n in multi):
            raise ValueError("a piece reaches across a word mark")
        alone = "\n" if not any("\n" in n for n in multi) else ""
        self.parts = re.compile(rf"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.longest = max(map(len, self.pieces))
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """Transitions (state, character) -> state in an open hash table; the piece that ends in a state."""
        states: dict[str, int] = {"": 0}
        for name in self.pieces:
            for n in range(1, len(name) + 1):
                states.setdefault(name[:n], len(states))
        self.ends = np.full(len(states), -1, np.int64)
        for name, i in self.pieces.items():
            self.ends[states[name]] = i
        keys = np.array([(states[p[:-1]] << 21) | ord(p[-1]) for p in states if p], np.int64)
        values = np.array([s for p, s in states.items() if p], np.int64)
        self.mask = (1 << (2 * len(states)).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        self.first = np.full(0x110000, -1, np.int64)  # the state after one character
        one = keys < 1 << 21
        self.first[keys[one]] = values[one]
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.next[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.mask.bit_length())).astype(np.int64)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = (state << 21) | char
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def split(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))

    def _edges(self, chars: np.ndarray, width: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all edges, by length and then by place. A node's next one in its part lies
        width further; inner: whether it has one."""
        active = np.flatnonzero(inner)
        state, at, out = np.zeros(len(active), np.int64), active, []
        for n in range(self.longest):
            state = self._step(state, chars[at]) if n else self.first[chars[at]]
            known = state >= 0
            if n == 0 and not known.all():
                lost = active[~known]
                out.append((lost, lost + width[lost], FALLBACK + chars[lost]))
            active, state, at = active[known], state[known], at[known]
            at = at + width[at]
            piece = self.ends[state]
            hit = np.flatnonzero(piece >= 0)
            out.append((active[hit], at[hit], piece[hit]))
            if n == 0 and len(hit) < len(active):
                lost = active[piece < 0]
                out.append((lost, lost + width[lost], FALLBACK + chars[lost]))
            more = inner[at]
            active, state, at = active[more], state[more], at[more]
            if not len(active):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _log(self, piece: np.ndarray) -> np.ndarray:
        spelt = piece >= FALLBACK
        char = np.where(spelt, piece - FALLBACK, 0)
        size = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        return np.where(spelt, size * self.byte_log, self.log_weight[np.where(spelt, 0, piece)])

    def forget(self) -> None:
        """An empty store of lattices: parts by number (first and last node), nodes, edges."""
        self.numbers: dict[str, int] = {}
        self.part_ends, self.nodes = [Column(np.int64), Column(np.int64)], Column(np.int64)
        self.edges = [Column(np.int32), Column(np.int32), Column(np.float64)]  # from node, piece, sum of shares so far

    def sample(self, parts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all parts one after the other, and how many each part has. Lattices of parts are kept
        for the next call (up to KEPT_NODES nodes; what is kept changes the time only)."""
        if self.nodes.size > KEPT_NODES:
            self.forget()
        if new := set(parts).difference(self.numbers):
            self._learn(list(new))
        own = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        return self._walk(self.part_ends[1].view()[own], self.part_ends[0].view()[own], *(c.view() for c in (*self.edges, self.nodes)), seeds)

    def _learn(self, distinct: list[str]) -> None:
        """The lattices of new parts.

        A part's nodes are its characters' places and one more for its end. They are laid out by place, at
        each place the longest parts first, so what is at one place of all parts is contiguous. Sums are in
        logarithms and taken within a node only: what else is in the batch changes nothing."""
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        by_size = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_size] = np.arange(len(size))
        lens = size[by_size]
        count = np.searchsorted(-lens, -np.arange(int(lens[0]) + 1), side="right")  # parts that have a node at each place
        first_at = np.concatenate([[0], np.cumsum(count)])
        total = int(first_at[-1])
        begin = np.cumsum(lens) - lens
        row = np.repeat(np.arange(len(lens)), lens)
        nodes = first_at[np.arange(len(row)) - begin[row]] + row
        chars = np.zeros(total, np.int64)
        chars[nodes] = np.frombuffer("".join(map(distinct.__getitem__, by_size.tolist())).encode("utf-32-le", "surrogatepass"), "<u4")
        inner = np.zeros(total, bool)
        inner[nodes] = True
        del row, nodes
        start, end, piece = self._edges(chars, np.repeat(count, count), inner)
        order = np.argsort(end, kind="stable")
        start, piece = start[order], piece[order]
        each = np.bincount(end, minlength=total)  # edges that end in each node: at least one but in the first ones
        first = np.cumsum(each) - each
        share = self._shares(start, self._log(piece), each, first, first_at)
        upto = share
        more = np.flatnonzero(each > 1)
        for j in range(1, int(each.max())):
            at = first[more] + j
            upto[at] += upto[at - 1]
            more = more[each[more] > j + 1]
        upto[first[each > 0] + each[each > 0] - 1] = 2.0  # the last edge of a node always stops the search
        nodes, edges = self.nodes.size, self.edges[0].size
        self.numbers.update(zip(distinct, range(self.part_ends[0].size, self.part_ends[0].size + len(distinct)), strict=True))
        self.part_ends[0].add(nodes + rank)
        self.part_ends[1].add(nodes + first_at[size] + rank)
        self.nodes.add(edges + first)
        for column, values in zip(self.edges, (start + nodes, piece, upto), strict=True):
            column.add(values)

    @staticmethod
    def _shares(start: np.ndarray, log_w: np.ndarray, each: np.ndarray, first: np.ndarray, first_at: np.ndarray) -> np.ndarray:
        """Each edge's part of the sum over the paths to its end."""
        alpha, share = np.zeros(len(each)), np.empty(len(start))
        edge_at = np.append(first, len(start))[first_at].tolist()
        for place in range(1, len(first_at) - 1):
            a, b = edge_at[place], edge_at[place + 1]
            low, high = first_at[place], first_at[place + 1]
            value = alpha[start[a:b]] + log_w[a:b]
            if b - a == high - low:  # one edge each
                alpha[low:high] = value
                share[a:b] = 1.0
                continue
            at, many = first[low:high] - a, each[low:high]
            top = np.maximum.reduceat(value, at)
            value = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(value, at)
            alpha[low:high] = top + np.log(total)
            share[a:b] = value / np.repeat(total, many)
        return share

    @staticmethod
    def _walk(at, stop, from_node, piece, upto, first_edge, seeds):
        """From each part's end to its start: an edge by its share, at every step."""
        active = np.arange(len(at))
        steps, each = [], np.zeros(len(at), np.int64)
        while len(active):
            edge = first_edge[at]
            u = uniforms(seeds[active], len(steps))
            later = np.flatnonzero(u >= upto[edge])
            while len(later):
                edge[later] += 1
                later = later[u[later] >= upto[edge[later]]]
            steps.append((active, piece[edge]))
            each[active] += 1
            at = from_node[edge]
            inside = at != stop[active]
            active, at = active[inside], at[inside]
        out = np.empty(int(each.sum()), np.int64)
        end = np.cumsum(each)
        for i, (who, what) in enumerate(steps):
            out[end[who] - 1 - i] = what
        return out, each

    def spell(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids, with characters that have no piece spelt in bytes."""
        spelt = np.flatnonzero(pieces >= FALLBACK)
        if not len(spelt):
            return pieces
        text = ["▁" if (c := chr(int(p) - FALLBACK)) == OWN_MARK else c for p in pieces[spelt]]
        ids = [[self.byte[b] for b in c.encode()] for c in text]
        size = np.ones(len(pieces), np.int64)
        size[spelt] = [len(x) for x in ids]
        out = np.repeat(pieces, size)
        at = (np.cumsum(size) - size)[spelt]
        for a, x in zip(at.tolist(), ids, strict=True):
            out[a : a + len(x)] = x
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


@lru_cache(maxsize=2)
def lattices(path: str = MODEL, theta: float = THETA) -> Lattices:
    return Lattices(path, theta)


def encode_rows(keys: list[int | None], texts: list[str], path: str = MODEL, seed: int = SEED, theta: float = THETA) -> list[np.ndarray]:
    """The piece ids of each text."""
    model = lattices(path, theta)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    words, rows, draws = [], [], []

    def flush() -> None:
        if not words:
            return
        pieces, each = model.sample(words, np.concatenate(draws))
        at = np.concatenate([[0], np.cumsum(each)])
        done = 0
        for row, n in rows:
            out[row].append(model.spell(pieces[at[done] : at[done + n]]))
            done += n
        words.clear(), rows.clear(), draws.clear()

    for row, (key, text) in enumerate(zip(keys, texts, strict=True)):
        own = model.split(text)
        for start in range(0, len(own), CHUNK_WORDS):
            part = own[start : start + CHUNK_WORDS]
            words.extend(part)
            rows.append((row, len(part)))
            draws.append(row_seeds(key, start, len(part), seed))
            if len(words) >= CHUNK_WORDS:
                flush()
    flush()
    return [np.concatenate(x) for x in out]


def reference_sample(key: int | None, text: str, path: str = MODEL, seed: int = SEED, theta: float = THETA) -> list[int]:
    """The same sampling written plainly, one text at a time, in logarithms."""
    model = lattices(path, theta)
    parts = model.split(text)
    out: list[int] = []
    for part, own in zip(parts, row_seeds(key, 0, len(parts), seed), strict=True):
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part) + 1)]
        alpha = [0.0] + [-math.inf] * len(part)
        for end in range(1, len(part) + 1):
            for start in range(end - 1, max(0, end - model.longest) - 1, -1):
                piece = model.pieces.get(part[start:end])
                if piece is None and end - start == 1:
                    piece = FALLBACK + ord(part[start])
                if piece is not None:
                    into[end].append((start, piece, alpha[start] + float(model._log(np.array([piece]))[0])))
            top = max(v for _, _, v in into[end])
            alpha[end] = top + math.log(sum(math.exp(v - top) for _, _, v in into[end]))
        end, chosen = len(part), []
        while end:
            share = [math.exp(v - alpha[end]) for _, _, v in into[end]]
            upto = np.cumsum(share).tolist()
            i = min(bisect_right(upto, float(uniforms(np.array([own]), len(chosen))[0])), len(share) - 1)
            chosen.append(into[end][i][1])
            end = into[end][i][0]
        out += model.spell(np.array(chosen[::-1])).tolist()
    return out


def _encoded(path: str, seed: int, theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                ids = encode_rows(rows.column(0).to_pylist(), [x or "" for x in rows.column(1).to_pylist()], path, seed, theta)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """doc_id and the sampled piece ids of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(model, seed, theta), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [lattices(path).decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of every encoded row."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, text string")


def _digests(path: str, seed: int, theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(path, theta)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                texts = [x or "" for x in rows.column(1).to_pylist()]
                ids = encode_rows(rows.column(0).to_pylist(), texts, path, seed, theta)
                back = [model.decode(x.tolist()) for x in ids]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return run


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again, and both digested in one pass."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digests(MODEL, SEED, THETA), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
