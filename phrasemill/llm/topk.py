"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and cut into blocks of rows. A block holds, for every component, the
leading bits of its rows' values as bitmaps (slices), and the integers themselves. A query's weights are
rounded to a few leading bits; the slices are then added with bitmap arithmetic (carry-save adders over
stacks of slices of one significance), which gives every row's coarse score as slices again. The rows with
the highest coarse scores are selected from the most significant slice downward; how far a coarse score can
be off is bounded by Cauchy-Schwarz from the block's largest remainder, and all rows within that bound of
the selected ones (the boundary rows) get their exact scores. So the result is exact, ties by vec_id.

The contract asks for every query against every row. Query blocks meet index blocks by an equi-join on the
block's number and the query block's share; a share is SHARE query blocks at most, so a pair of numbers is a
bounded piece of work, and an index block is sent once for each share.

Scores are exact integers of any size: sums that may pass 2**53 are taken in 64-bit integers, those that may
pass 2**63 in Python's, as are all scores of rows and queries with components beyond the index (REACH). A score
outside a long is returned as the nearest long, and ranked by its true value.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no part; a
query is not its own candidate, by id; rows that repeat an id are candidates of their own for others, and as
queries they all ask: the k highest of all their scores, a candidate once for each; shorter vectors count as
padded with zeros; very long vectors are taken whole; fewer candidates than k give fewer rows; an empty table
gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.session import stored, table

SCALE, K, EVERY = 256, 5, 50
BLOCK_ROWS, QUERY_ROWS, SHARE = 16_384, 128, 64
ROW_BITS, WEIGHT_BITS = 7, 5
REACH = 1 << 61  # quantised components from here on are not indexed: their rows are scored one by one


def quantise(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def whole(vector: np.ndarray) -> list[int]:
    """The quantised components of a vector of any finite doubles."""
    return [int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in vector.tolist()]


def padded(vectors: list[list[float]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = -(-abs(score).bit_length() // 8)
    return (0x8000 + size).to_bytes(2) + score.to_bytes(size) if score >= 0 else (0x7FFF - size).to_bytes(2) + (score + (1 << 8 * size)).to_bytes(size)


class Block:
    """Rows of an index: ids, integers, and slices of their leading bits; rows beyond REACH apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        far = (np.abs(vectors) >= REACH / SCALE).any(axis=1)
        self.far = [(int(i), whole(v)) for i, v in zip(ids[far], vectors[far], strict=True)]
        self.ids, self.values = ids[~far], quantise(vectors[~far])
        self.n, self.width = self.values.shape
        if self.n:
            self._slice(self.values)

    def _slice(self, values: np.ndarray) -> None:
        self.words = -(-self.n // 64)
        self.low = values.min(axis=0)
        reach = int((values.max(axis=0) - self.low).max()) if self.width else 0
        self.drop = max(0, reach.bit_length() - ROW_BITS)
        coarse = ((values - self.low) >> self.drop).astype(np.uint8)
        bits = np.unpackbits(coarse.T[:, :, None], axis=2, bitorder="little")[:, :, :ROW_BITS]
        packed = np.zeros((self.width, ROW_BITS, self.words * 8), np.uint8)
        packed[:, :, : -(-self.n // 8)] = np.packbits(bits, axis=1, bitorder="little").transpose(0, 2, 1)
        self.slices = packed.view(np.uint64)
        self.real = np.zeros(self.words * 8, np.uint8)
        self.real[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.real = self.real.view(np.uint64)
        rest = values - self.low - (coarse.astype(np.int64) << self.drop) - ((1 << self.drop) - 1) / 2
        self.rest = float(np.sqrt((rest**2).sum(axis=1)).max())
        self.reach = float(np.sqrt(((values - values.mean(axis=0)) ** 2).sum(axis=1)).max())
        self.most = int(np.abs(values).max(initial=0))
        self.exact = values.astype(np.float64)

    def coarse_scores(self, weight: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum(weight * coarse) over positive weights plus
        sum(-weight * (top - coarse)) over negative ones."""
        stacks: dict[int, list[np.ndarray]] = {}
        size = np.abs(weight)
        for bit in range(int(size.max()).bit_length()):
            chosen = np.flatnonzero((size >> bit) & 1)
            if len(chosen):
                own = self.slices[chosen]
                own[weight[chosen] < 0] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
                for s in range(ROW_BITS):
                    stacks.setdefault(bit + s, []).append(own[:, s])
        out, at = [], 0
        while at in stacks or any(x > at for x in stacks):
            stack = np.concatenate(stacks.pop(at)) if at in stacks else np.zeros((1, self.words), np.uint64)
            while len(stack) > 1:
                third = max(1, len(stack) // 3)
                a, b = stack[:third], stack[third : 2 * third]
                half = a ^ b
                if len(stack) == 2:
                    total, carry, left = half, a & b, stack[2:]
                else:
                    c = stack[2 * third : 3 * third]
                    total, carry, left = half ^ c, (a & b) | (half & c), stack[3 * third :]
                stacks.setdefault(at + 1, []).append(carry)
                stack = np.concatenate([total, left])
            out.append(stack[0])
            at += 1
        return out

    def search(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows for a vector of doubles."""
        asked = whole(query)
        found = [(sum(map(mul, v, asked)), i) for i, v in self.far if i != own_id]
        if self.n:
            found += self._near(asked, own_id, k)
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]

    def _near(self, asked: list[int], own_id: int, k: int) -> list[tuple[int, int]]:
        if any(abs(x) >= REACH for x in asked):
            return [(sum(map(mul, v, asked)), i) for i, v in zip(self.ids.tolist(), self.values.tolist(), strict=True) if i != own_id]
        q = np.zeros(self.width, np.int64)
        q[: min(len(asked), self.width)] = asked[: self.width]
        drop = max(0, int(np.abs(q).max(initial=0)).bit_length() - WEIGHT_BITS)
        weight = np.sign(q) * ((np.abs(q) + ((1 << drop) >> 1)) >> drop)
        if weight.any():
            scores = self.coarse_scores(weight)
            level, found = self._level(scores, k + int((self.ids == own_id).sum()))
            off = np.linalg.norm(weight << drop) * self.rest + np.linalg.norm(q - (weight << drop)) * self.reach
            slack = int(np.ceil(2 * off / (1 << (drop + self.drop)))) + 1
            at = np.flatnonzero(np.unpackbits(self._at_least(scores, level - slack).view(np.uint8), bitorder="little")) if found else np.arange(self.n)
        else:
            at = np.arange(self.n)
        at = at[self.ids[at] != own_id]
        most = self.most * sum(map(abs, asked))
        if most >= 1 << 63:
            return [(sum(map(mul, v, asked)), i) for i, v in zip(self.ids[at].tolist(), self.values[at].tolist(), strict=True)]
        exact = self.exact[at] @ q.astype(np.float64) if most < 1 << 53 else self.values[at] @ q
        if len(at) > k:
            kept = exact >= np.partition(exact, len(at) - k)[len(at) - k]
            at, exact = at[kept], exact[kept]
        order = np.lexsort((self.ids[at], -exact))[:k]
        return [(int(exact[i]), int(self.ids[at[i]])) for i in order]

    def _level(self, scores: list[np.ndarray], k: int) -> tuple[int, bool]:
        """The k-th highest score, from the most significant slice downward."""
        if self.n <= k:
            return 0, False
        above, tied, level = np.zeros(self.words, np.uint64), self.real.copy(), 0
        for bit in range(len(scores) - 1, -1, -1):
            with_bit = tied & scores[bit]
            if int(np.bitwise_count(above | with_bit).sum()) >= k:
                tied, level = with_bit, level | (1 << bit)
            else:
                above, tied = above | with_bit, tied & ~scores[bit]
        return level, True

    def _at_least(self, scores: list[np.ndarray], level: int) -> np.ndarray:
        if level <= 0:
            return self.real
        above, tied = np.zeros(self.words, np.uint64), self.real.copy()
        for bit in range(len(scores) - 1, -1, -1):
            if (level >> bit) & 1:
                tied = tied & scores[bit]
            else:
                above, tied = above | (tied & scores[bit]), tied & ~scores[bit]
        return above | tied


def _save(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    out = io.BytesIO()
    single = vectors.astype(np.float32)
    np.savez(out, ids=ids, vectors=single if (single == vectors).all() else vectors)
    return out.getvalue()


def _load(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return found["ids"], found["vectors"].astype(np.float64)


def _blocks(size: int):
    def build(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        blobs = [_save(ids[i : i + size], padded(group.column("v").slice(i, size).to_pylist())) for i in range(0, len(ids), size)]
        return pa.table({"number": group.column("number").slice(0, len(blobs)), "blob": pa.array(blobs, pa.binary())})

    return build


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows (dealt by a hash of the row): number, blob; and how many numbers there are."""
    count = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("number", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))
    return stored(dealt.groupBy("number").applyInArrow(_blocks(4 * size), "number int, blob binary")), count


def _searched(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Block] | None = None
        for batch in batches:
            for index, queries in zip(batch.column(0), batch.column(1), strict=True):
                blob = index.as_buffer().to_pybytes()
                if last is None or last[0] != blob:
                    last = (blob, Block(*_load(blob)))
                rows = [(int(i), v, s) for i, q in zip(*_load(queries.as_buffer().to_pybytes()), strict=True) for s, v in last[1].search(q, int(i), k)]
                query, found, score = zip(*rows, strict=True) if rows else ((), (), ())
                held = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in score]
                columns = [*(pa.array(c, pa.int64()) for c in (query, found, held)), pa.array(map(sortable, score), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "exact"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors for each row of queries (both: vec_id, embedding)."""

    def sound(rows: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)

    index, numbers = _packed(sound(vectors), BLOCK_ROWS)
    asked, blocks = _packed(sound(queries), QUERY_ROWS)
    shares = -(-blocks // SHARE)
    wide = asked.select(F.col("blob").alias("queries"), F.pmod("number", F.lit(shares)).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("number"))
    dealt = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    pairs = dealt.join(wide, ["number", "share"]).select("blob", "queries")
    found = pairs.mapInArrow(_searched(k), "query_id long, vec_id long, score long, exact binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = {
    "op4_exact_top_k": """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
}
QUERIES = {"op4_exact_top_k": op4_exact_top_k}
