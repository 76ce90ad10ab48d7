"""SimHash near-duplicates, linked through vantage-point trees.

Distinct fingerprints are dealt to shards by shallow trees that are fitted on a bounded sample, one tree for
each of three parts of the 64 bits: two fingerprints within 4 bits differ in one bit at most in some part, and
a ball of radius 1 in 21 bits overlaps far fewer shards than one of radius 4 in 64. A node holds a vantage point
and a distance; what lies within goes left, the rest right. A fingerprint lives in one leaf of each tree and also
visits the lower-numbered leaves that its ball overlaps (triangle bounds prune the others), so every pair meets.
A shard searches its residents, by all 64 bits, with a tree of its own and returns a spanning forest of the
links, never all pairs.

A tree has up to LEAVES leaves. Where a leaf would hold many more than SHARD residents, they are dealt to several
shards by the part itself; the ball of radius 1 of a part has few members, so what visits such a leaf goes to the
shards of those members that lie in the leaf. So shards stay small however many fingerprints there are, and no
fingerprint goes to more shards than its balls have members (66 with three parts).

Defined results: a null text has no words; a text without words has fingerprint zero; repeated rows
share their fingerprint; a very long text is taken whole; a null doc_id takes part but never names a component
(all null: null); an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.blobs import trimmed
from phrasemill.llm.components import connected
from phrasemill.llm.skew import hot_join
from phrasemill.session import saved, table

SEED, SHINGLE, RADIUS = 42, 4, 4
BLOCKS = 3  # 4 differing bits are at most one in one of three parts of the bits
SAMPLE = 8192  # fingerprints that the shards' trees are fitted on, at most
SHARD = 2048  # fingerprints that live in a shard of one tree, about
LEAVES = 1024  # of a shards' tree, at most
TASK_SHARDS = 8  # shards of a task, about
LEAF = 128  # residents of a leaf of a shard's own tree


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, in the order of unpackbits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    return int(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_fingerprints), "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """An inner node (point, cut, inside, outside) or a leaf (its number)."""

    leaf: int = -1
    point: int = 0
    cut: int = 0
    inside: "Node | None" = None
    outside: "Node | None" = None


def _choose(points: np.ndarray) -> tuple[int, int] | None:
    """Of a few candidates the vantage point and the cut at (or next to) the median that part the points
    most evenly; of equals the one whose distances vary most. None if all points are one."""
    tried = np.unique(points)
    tried = tried[:: max(1, len(tried) // 7)][:8]
    far = distances(points[None, :], tried[:, None])
    middle = np.median(far, axis=1).astype(int)
    best = None
    for row, point, cut in [(row, p, m - less) for row, p, m in zip(far, tried, middle, strict=True) for less in (0, 1)]:
        share = float((row <= cut).mean())
        if 0 < share < 1 and (best is None or (abs(share - 0.5), -row.std()) < best[0]):
            best = ((abs(share - 0.5), -row.std()), int(point), int(cut))
    return best and best[1:]


def grow(points: np.ndarray, leaf: int, leaves: int | None = None) -> Node:
    """A vantage-point tree: the largest leaf is split until all hold ``leaf`` points at most or there are
    as many leaves as wanted. Leaves are numbered from left (inside) to right."""
    root, count = Node(), 1
    heap = [(-len(points), 0, root, points)]
    made = 1
    while heap and (leaves is None or count < leaves):
        size, _, node, own = heapq.heappop(heap)
        if -size <= leaf:
            break
        found = _choose(own)
        if found is None:
            continue
        node.point, node.cut = found
        near = distances(own, np.uint64(node.point)) <= node.cut
        node.inside, node.outside = Node(), Node()
        for child, part in ((node.inside, own[near]), (node.outside, own[~near])):
            heapq.heappush(heap, (-len(part), made, child, part))
            made += 1
        count += 1
    stack, number = [root], 0
    while stack:
        node = stack.pop()
        if node.inside is None:
            node.leaf, number = number, number + 1
        else:
            stack += [node.outside, node.inside]
    return root


def route(root: Node, marks: np.ndarray, visiting: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices that live there, indices that visit it). A mark that is not visiting lives in one
    leaf and visits lower leaves only; a visiting mark goes to every leaf that its ball may overlap."""
    stack = [(root, np.flatnonzero(~visiting), np.flatnonzero(visiting))]
    while stack:
        node, home, visit = stack.pop()
        if not len(home) and not len(visit):
            continue
        if node.inside is None:
            yield node.leaf, home, visit
            continue
        far = distances(marks[home], np.uint64(node.point)).astype(np.int16)
        away = distances(marks[visit], np.uint64(node.point)).astype(np.int16)
        outer = home[far > node.cut]
        crossing = home[(far > node.cut) & (far - radius <= node.cut)]
        stack.append((node.outside, outer, visit[away + radius > node.cut]))
        stack.append((node.inside, home[far <= node.cut], np.concatenate([crossing, visit[away - radius <= node.cut]])))


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while (nxt := self.parent[up]).tolist() != up.tolist():
            up = nxt
        self.parent[at] = up
        return up

    def _find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links in bulk: of those that still part two trees, one for each end is tried, and again."""
        while True:
            apart = self.roots(a) != self.roots(b)
            a, b = a[apart], b[apart]
            if not len(a):
                return
            tried = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
            for x, y in zip(a[tried].tolist(), b[tried].tolist(), strict=True):
                p, q = self._find(x), self._find(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    self.kept.append((x, y))


def shard_links(homes: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A spanning forest (pairs of marks) of all links home-home and home-visitor within the radius."""
    marks = np.concatenate([homes, visitors])
    visiting = np.arange(len(marks)) >= len(homes)
    forest = Forest(len(marks))
    tree = grow(homes, LEAF)
    for _, home, visit in route(tree, marks, visiting, radius):
        if not len(home):
            continue
        near = np.triu(distances(marks[home][:, None], marks[home][None, :]) <= radius, 1)
        i, j = np.nonzero(near)
        forest.add(home[i], home[j])
        step = max(1, (1 << 21) // len(home))
        for at in range(0, len(visit), step):
            part = visit[at : at + step]
            i, j = np.nonzero(distances(marks[part][:, None], marks[home][None, :]) <= radius)
            forest.add(part[i], home[j])
    return marks[np.array(forest.kept, np.int64).reshape(-1, 2)]


def blocks(marks: np.ndarray, count: int = BLOCKS) -> list[np.ndarray]:
    """The marks' bits in ``count`` parts of one width or nearly so."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(marks >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def leaf_of(root: Node, marks: np.ndarray) -> np.ndarray:
    """The leaf that each mark lives in."""
    out = np.empty(len(marks), np.int32)
    for leaf, home, _ in route(root, marks, np.zeros(len(marks), bool), -1):
        out[home] = leaf
    return out


def shards(root: Node, splits: np.ndarray, part: np.ndarray, width: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf, shard in the leaf, index, whether it lives there) for marks of ``width`` bits."""
    steps = np.concatenate([[0], np.uint64(1) << np.arange(width, dtype=np.uint64)]).astype(np.uint64)
    for leaf, home, visit in route(root, part, np.zeros(len(part), bool), radius):
        count = np.uint64(splits[leaf])
        if count == 1:
            own = np.concatenate([home, visit])
            yield leaf, np.zeros(len(own), np.int64), own, np.arange(len(own)) < len(home)
            continue
        yield leaf, (part[home] % count).astype(np.int64), home, np.ones(len(home), bool)
        who = np.concatenate([home, visit])
        around = part[who][:, None] ^ steps[None, :]
        to = (around % count).astype(np.int64)
        goes = leaf_of(root, around.reshape(-1)).reshape(around.shape) == leaf
        goes[: len(home)] &= to[: len(home)] < to[: len(home), :1]  # residents visit lower-numbered shards
        row, step = np.nonzero(goes)
        pairs = np.unique(np.stack([to[row, step], row]), axis=1)
        yield leaf, pairs[0], who[pairs[1]], np.zeros(pairs.shape[1], bool)


def link_classes(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links u, v between the distinct fingerprints in column fp: as many as keep every component whole."""
    total = classes.count()
    wanted = min(LEAVES, max(1, -(-total // SHARD)))
    rows = classes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()
    sample = blocks(np.array([r.fp for r in rows], np.int64).view(np.uint64))
    trees = [grow(part, 2, wanted) for part in sample]
    near = radius // BLOCKS
    splits, each = [], max(1, total / max(1, len(rows)))
    for tree, part in zip(trees, sample, strict=True):
        residents = np.bincount(leaf_of(tree, part), minlength=wanted) * each
        splits.append(np.maximum(1, residents // SHARD).astype(np.int64) if near <= 1 else np.ones(wanted, np.int64))
    widths = [64 * (i + 1) // BLOCKS - 64 * i // BLOCKS for i in range(BLOCKS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, (tree, part) in enumerate(zip(trees, blocks(marks), strict=True)):
                for leaf, place, own, lives in shards(tree, splits[number], part, widths[number] if near else 0, near):
                    shard = (np.int64(number * LEAVES + leaf) << 32) | place
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(marks[own].view(np.int64)), pa.array(lives)], ["shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        marks = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        found = shard_links(np.sort(marks[home]), np.sort(marks[~home]), radius).view(np.int64)
        return pa.table({"u": pa.array(found[:, 0].copy(), pa.int64()), "v": pa.array(found[:, 1].copy(), pa.int64())})

    dealt = classes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), BLOCKS * -(-total // (SHARD * TASK_SHARDS)))
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs."""
    marks = saved(fingerprints(docs))
    classes = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = connected(link_classes(classes, radius))
    member = roots.join(classes.withColumnRenamed("fp", "node"), "node").select("node", "root", "first")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = hot_join(saved(member), least, ["root"], "members").select(F.col("node").alias("fp"), "component_id")
    every = saved(classes.join(named, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first").alias("component_id")))
    return hot_join(marks, every, ["fp"], "copies", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without those whose component has a smaller doc_id; its own columns. Rows that repeat a
    doc_id are the same document and stay together."""
    stay = near_duplicates(docs, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["stays"]), "left_semi")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
