"""Packing of documents into sequences of a fixed number of tokens.

Lengths are at most the capacity, so the whole problem is a histogram of as many numbers, however many
documents there are. It is packed on the driver in patterns (a bin's contents, and how many bins have them) by
a local search that begins with every piece in an underfull bin of its own. Moves come first: the fullest
underfull bin takes the longest lone piece that fits best, which increases the sum of squared fills and
empties the piece's bin. Then moves, one-for-one and two-for-one exchanges between all underfull bins go on
increasing it, until none is left or the bins are as few as the tokens allow. Bins of one pattern go together:
what is done to two patterns is done as often as both have bins, so it uses up one of them and makes at most
two, and the work grows with the number of lengths, not of documents. Pieces find their places by their rank
among pieces of their length: a running number in each task, plus a sum over the tasks before (a table of as
many rows as tasks have lengths; it is broadcast up to BROADCAST rows and dealt out with the pieces beyond).

Defined results: a null text is empty (one end-of-document token); a document longer than the capacity is
cut, however long it is; ties (equal lengths) are placed in the order of tasks and rows; repeated rows are
packed one by one; an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.llm.blobs import arrow_rows, give_back, trimmed
from phrasemill.session import stored, table

CAPACITY, END = 4096, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHED_WORDS = 1_200_000
ROWS = 1024  # documents that a task takes at a time
BROADCAST = 500_000  # rows (task, length, sum) that may be broadcast: about 20 MB


class WordEncoder:
    """Token ids (little-endian 32-bit) of whole texts. The tokenizer drops white space and never joins
    words across it, so a text's ids are its words' ids; those are cached. New words of Latin-1 characters are
    split as the tokenizer does and go through its merges one by one; others go through the whole tokenizer
    together, parted by a word that is one token and stands in no other. Texts that may hold one of the
    tokenizer's special tokens, or the parting character, go through it whole."""

    PART = "\x01"
    # The tokenizer's own split, for Latin-1 characters (which no normal form changes) in lower case.
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        self.part = self._ids(self.PART)
        if len(self.part) != 1:
            raise ValueError("the parting word must be one token")
        # Bytes of the byte-level alphabet: printable ones stand for themselves, the others come after U+00FF.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [x for x in range(256) if x not in plain]
        self.letters = {x: 0x100 + i for i, x in enumerate(others)}
        if {chr(self.letters.get(x, x)) for x in range(256)} != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("the tokenizer's byte alphabet is another one")
        self.marks = {c: self._spelt(c) for c in ",.;:!?)"}  # never joined with a letter before them

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        ids = self._ids(f" {self.PART} ".join([w.decode() for w in words] + [""]))
        ends = np.flatnonzero(ids == self.part[0])
        if len(ends) != len(words):
            raise ValueError("a word holds the parting token")
        data = ids.tobytes()
        starts = (np.concatenate([[0], ends[:-1] + 1]) * 4).tolist()
        self.words.update(zip(words, map(data.__getitem__, map(slice, starts, (ends * 4).tolist())), strict=True))

    def _spelt(self, text: str) -> bytes:
        """The ids of Latin-1 characters in lower case."""
        if text.isascii() and text.isalpha():
            parts = (text,)
        else:
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in self.SPLIT.findall(text)]
        ids = [t.id for p in parts for t in self.tokenizer.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn_latin(self, words: list[bytes]) -> list[bytes]:
        """Learns words of Latin-1 characters, those that end in a mark by what is before it; the other words."""
        known, others = self.words, []
        for word in words:
            text = word.decode()
            if not text.isascii():
                if max(text) > "\xff" or "\x85" in text or "\xa0" in text:
                    others.append(word)
                    continue
                text = text.lower()
            if text[-1] in self.marks and text[:-1].isalpha():
                stem = text[:-1].encode()
                if stem not in known:
                    known[stem] = self._spelt(text[:-1])
                known[word] = known[stem] + self.marks[text[-1]]
            elif word not in known:
                known[word] = self._spelt(text)
        return others

    def encode(self, texts: list[bytes]) -> list[bytes]:
        whole = [b"<|" in t or b"\x01" in t for t in texts]
        split = [[] if odd else t.lower().split() for t, odd in zip(texts, whole, strict=True)]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        own = set().union(*split)
        new = self._learn_latin(list(own.difference(self.words)))
        for at in range(0, len(new), 4096):
            self._learn(new[at : at + 4096])
        get = dict(zip(own, map(self.words.__getitem__, own), strict=True)).__getitem__  # small, so that it stays in the processor's caches
        return [self._ids(t.decode()).tobytes() if odd else b"".join(map(get, s)) for t, odd, s in zip(texts, whole, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(path: str, capacity: int, end: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                out: list[tuple] = []
                for doc, ids in zip(rows.column(0).to_pylist(), encoder(path).encode(rows.column(1).to_pylist()), strict=True):
                    ids += tail
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc, piece, start // 4, n, zlib.crc32(own), part, int(seen[n]), own))
                        seen[n] += 1
                columns = list(zip(*out, strict=True)) if out else [[]] * 8
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")
                n = 8 if keep_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names[:n])

    return cut


def alone(counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Every piece in a bin of its own, as patterns (contents by length, number of bins)."""
    return [({x: 1}, n) for x, n in counts.items() if n > 0]


def fill(content: dict[int, int]) -> int:
    return sum(x * n for x, n in content.items())


def move_lone(patterns: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The fullest underfull bin takes the longest lone piece that fits (as often as it fits, if there are
    enough), until no lone piece fits in a bin that is fuller than its own."""
    lone: Counter[int] = Counter()
    bins: list[tuple[int, int, dict[int, int], int]] = []  # a heap: the fullest first
    for content, m in patterns:
        if sum(content.values()) == 1:
            lone.update({next(iter(content)): m})
        elif content:
            bins.append((-fill(content), len(bins), content, m))
    heapify(bins)
    made, mask, out = len(bins), sum(1 << x for x in lone), []

    def take(x: int, n: int) -> None:
        nonlocal mask
        lone[x] -= n
        if not lone[x]:
            mask &= ~(1 << x)

    while bins or mask:
        if bins and -bins[0][0] >= mask.bit_length() - 1:
            full, _, content, m = heappop(bins)
        else:  # the fullest bins are those of the longest lone pieces
            x = mask.bit_length() - 1
            each = min(capacity // x, lone[x])
            full, content, m = -each * x, {x: each}, lone[x] // each
            take(x, each * m)
        room = capacity + full
        fitting = mask & ((1 << room + 1) - 1)
        if not fitting:
            out.append((content, m))
            continue
        x = fitting.bit_length() - 1
        each = min(room // x, max(1, lone[x] // m))
        used = min(m, lone[x] // each)
        take(x, each * used)
        if used < m:
            made += 1
            heappush(bins, (full, made, content, m - used))
        made += 1
        heappush(bins, (full - each * x, made, content | {x: content.get(x, 0) + each}, used))
    return out


def local_search(patterns: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Moves of lone pieces, then exchanges between underfull bins that increase the sum of squared fills,
    until no two bins have one left or the bins are as few as the tokens allow. Bins of one pattern go
    together: an exchange of two patterns is made as often as both have bins."""
    patterns = move_lone(patterns, capacity)
    least = -(-sum(fill(content) * m for content, m in patterns) // capacity)
    total = sum(m for _, m in patterns)
    if total <= least:
        return patterns
    full = [(content, m) for content, m in patterns if fill(content) == capacity]
    search = _Search(capacity)
    for content, m in patterns:
        search.add(tuple(sorted(Counter(content).elements())), m)
    while total > least and (exchange := search.next()):
        total -= search.apply(*exchange)
    return full + search.full + [(dict(Counter(content)), m) for content, m in search.bins.items()]


class _Search:
    """Underfull patterns (sorted lengths) with their numbers of bins. Sums that a pattern can give (one or
    two of its lengths) and sums that it can take (up to its room more than nothing or than one of its
    lengths, which it gives back) are bits of numbers, so that two patterns are compared by one "and". A
    pattern is compared with all others once; after that only new ones can change its case."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: dict[tuple[int, ...], int] = {}
        self.gives: dict[tuple[int, ...], int] = {}
        self.takes: dict[tuple[int, ...], int] = {}
        self.order: list[tuple[int, tuple[int, ...]]] = []  # by fill
        self.new: list[tuple[int, tuple[int, ...]]] = []  # a heap: not compared yet, the emptiest first
        self.full: list[tuple[dict[int, int], int]] = []

    def add(self, content: tuple[int, ...], m: int) -> None:
        fill = sum(content)
        if fill == self.capacity or not content:
            return
        if content not in self.bins:
            counts = Counter(content)
            own = 0
            for x in counts:
                own |= 1 << x
            gives = own
            for x, n in counts.items():
                gives |= (own if n > 1 else own & ~(1 << x)) << x
            self.gives[content] = gives
            room = (1 << self.capacity - fill) - 1 << 1
            takes = room
            for y in counts:
                takes |= room << y
            self.takes[content] = takes
            insort(self.order, (fill, content))
        self.bins[content] = self.bins.get(content, 0) + m
        heappush(self.new, (fill, content))

    def drop(self, content: tuple[int, ...], m: int) -> None:
        self.bins[content] -= m
        if not self.bins[content]:
            del self.bins[content], self.gives[content], self.takes[content]
            del self.order[bisect_left(self.order, (sum(content), content))]

    def next(self) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """An emptier pattern that gives and a fuller one (perhaps the same) that takes."""
        while self.new:
            fill, own = self.new[0]
            if own in self.bins:
                gives, takes = self.gives[own], self.takes[own]
                for other, high in reversed(self.order):
                    if other < fill:
                        break
                    if gives & self.takes[high] and (high != own or self.bins[own] > 1):
                        return own, high
                for other, low in self.order:
                    if other > fill:
                        break
                    if takes & self.gives[low] and (low != own or self.bins[own] > 1):
                        return low, own
            heappop(self.new)
        return None

    def apply(self, low: tuple[int, ...], high: tuple[int, ...]) -> int:
        """Make the exchange that moves most; the number of bins that are empty after it."""
        room, gives = self.capacity - sum(high), self.gives[low]
        moved = lambda y: (gives & ((1 << room) - 1 << y + 1)).bit_length() - 1 - y
        back = max({0, *high}, key=lambda y: (moved(y), -y))
        given = moved(back) + back
        counts = Counter(low)
        out = (given,) if given in counts else next((x, given - x) for x in low if counts[given - x] > (2 * x == given))
        less, more = list(low), list(high)
        for x in out:
            less.remove(x)
            more.append(x)
        if back:
            more.remove(back)
            less.append(back)
        times = self.bins[low] // 2 if low == high else min(self.bins[low], self.bins[high])
        self.drop(low, times)
        self.drop(high, times)
        self.add(tuple(sorted(less)), times)
        self.add(tuple(sorted(more)), times)
        if sum(more) == self.capacity:
            self.full.append((dict(Counter(more)), times))
        return 0 if less else times


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: the rank-th piece of a length is in the slot with the last
    first <= rank; there, number i is in sequence base + i % bins at offset + i // bins * length."""
    rows, used, base = [], Counter(), 0
    for content, bins in patterns:
        offset = 0
        for length in sorted(content, reverse=True):
            rows.append((length, used[length], bins, base, offset))
            used[length] += content[length] * bins
            offset += content[length] * length
        base += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "bins", "base", "offset"), columns, strict=True))


def _place(where: dict[str, np.ndarray], extra: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # all texts are cut: a worker that goes on with other tasks would keep its words
        give_back()
        starts = {int(x): int(i) for x, i in zip(*np.unique(where["length"], return_index=True), strict=True)}
        ends = {int(x): int(i + n) for x, i, n in zip(*np.unique(where["length"], return_index=True, return_counts=True), strict=True)}
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                at[own] = starts[x] + np.searchsorted(where["first"][starts[x] : ends[x]], rank[own], side="right") - 1
            i = rank - where["first"][at]
            sequence = where["base"][at] + i % where["bins"][at]
            offset = where["offset"][at] + i // where["bins"][at] * length
            kept = [batch.column(c) for c in range(extra)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:extra], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids: little-endian 32-bit,) sequence_id and offset of every piece."""
    schema = _PIECES + ", ids binary" * keep_ids
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(trimmed(_cut(tokenizer, capacity, end, keep_ids)), schema)
    with arrow_rows(docs.sparkSession, ROWS):
        pieces = stored(cut)
    tasks = stored(pieces.groupBy("part", "length").count())
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    where = slots(local_search(alone(counts), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if tasks.count() <= BROADCAST else bases.hint("shuffle_hash")
    ids = ["ids"] * keep_ids
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("rank") + F.col("base")).alias("rank"))
    kept = schema.replace(", part int, rank long", "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(where, 5 + keep_ids), kept)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
