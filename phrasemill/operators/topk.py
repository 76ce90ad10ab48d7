"""Frequent items and prefixes over DataFrames, exact and bounded.

``sequential`` keeps one ordered stream for each group and reproduces the order-dependent summary; it is
for groups of bounded size. ``mergeable`` summarizes each partition on its own and adds the summaries up:
with k counters each, an item's count is short by at most N / (k + 1) over all partitions, and the table of
partial counters has at most partitions x k rows, however large the input is. The two are different contracts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.operators.summaries import LinearCountMin, PrefixSummary, summarize

GRAM_BYTES = 1 << 20  # bytes whose grams are counted at a time


def topk_exact(rows: DataFrame, item: str, k: int) -> DataFrame:
    """item, n of the k most frequent items, ties by item."""
    return rows.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def topk_sequential(rows: DataFrame, group: str, item: str, order: str, k: int, max_freq: int = 1 << 30, kind: str = "mg") -> DataFrame:
    """group, item, n: the summary of each group's items read in order."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable")
        found = summarize(own[item].tolist(), k, max_freq, kind)
        return pd.DataFrame({group: [own[group].iloc[0]] * len(found), item: [i for i, _ in found], "n": [n for _, n in found]})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, item)}
    return rows.select(group, item, order).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, n long")


def topk_mergeable(rows: DataFrame, item: str, k: int) -> DataFrame:
    """item, n, error: n <= true count <= n + error for items that are there; items that are not have a
    true count of at most error. Batches are counted first, then taken into k counters of the partition:
    the (k+1)-th largest count is taken off all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        lost = 0
        for batch in batches:
            found = batch.column(0).value_counts()
            for value, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[value] += n
            if len(counts) > k:
                cut = sorted(counts.values(), reverse=True)[k]
                lost += cut
                counts = Counter({i: n - cut for i, n in counts.items() if n > cut})
        items = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(items, batch_type), pa.array([counts[i] for i in items], pa.int64()), pa.array([lost if j == 0 else 0 for j in range(len(items))], pa.int64())], ["item", "n", "error"])

    kind = rows.schema[item].dataType
    batch_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind.simpleString()]
    parts = rows.select(item).mapInArrow(partial, f"item {kind.simpleString()}, n long, error long")
    merged = parts.groupBy("item").agg(F.sum("n").alias("n"))
    error = parts.agg(F.coalesce(F.sum("error"), F.lit(0)).alias("error"))  # one row
    return merged.join(F.broadcast(error), F.lit(True)).orderBy(F.desc("n"), "item").limit(k).withColumnRenamed("item", item)


def frequent_prefixes(rows: DataFrame, column: str, k: int, max_freq: int = 1 << 20) -> list[bytes]:
    """At most k strings (closed under prefixes) that bounded dictionaries of the partitions hold most
    often; partial dictionaries have k strings each, and only k strings come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = PrefixSummary(k, max_freq)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                state = top.EMPTY
                for c in data or b"":
                    state = top.extend(state, c)
                    if not state[2]:
                        state = top.EMPTY
        own = top.strings()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.binary()), pa.array([n for _, n in own], pa.int64())], ["s", "n"])

    parts = rows.select(column).mapInArrow(partial, "s binary, n long")
    best = parts.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.octet_length("s"), "s").limit(k).collect()
    kept: set[bytes] = {b""}
    for s in sorted((bytes(r.s) for r in best), key=len):
        if s[:-1] in kept:
            kept.add(s)
    return sorted(kept - {b""})


SKETCH_PRIME = (1 << 31) - 1


def sketch_factors(row: int) -> tuple[int, int]:
    """The two numbers of a row's hash function (a * x + b) mod SKETCH_PRIME mod width."""
    return 1103515245 * (row + 1) % SKETCH_PRIME, 12345 * (row + 7) * (row + 7) % SKETCH_PRIME


def _cells(rows: DataFrame, item: Column, depth: int, width: int) -> Column:
    """(row, cell) of an item in every row of a sketch. Whole numbers are hashed as they are (modulo the prime),
    anything else by 64 bits first; no product passes a long."""
    integral = rows.select(item).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    x = F.pmod(item.cast("long") if integral else F.xxhash64(item), F.lit(SKETCH_PRIME))
    places = []
    for r in range(depth):
        a, b = sketch_factors(r)
        places.append(F.struct(F.lit(r).alias("row"), F.pmod(F.pmod(x * a + b, F.lit(SKETCH_PRIME)), F.lit(width)).alias("cell")))
    return F.explode(F.array(*places))


def sketch_cells(rows: DataFrame, item: Column, depth: int = 2, width: int = 1 << 12) -> DataFrame:
    """A Count-Min sketch as rows (row, cell, n): one aggregation with partial sums; at most depth x width rows."""
    return rows.select(_cells(rows, item, depth, width).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def sketch_estimates(items: DataFrame, item: Column, cells: DataFrame, depth: int = 2, width: int = 1 << 12) -> DataFrame:
    """items with an ``estimate``: the least of its cells, never below the true count."""
    asked = items.withColumn("c", _cells(items, item, depth, width)).select(*items.columns, "c.row", "c.cell")
    return asked.join(F.broadcast(cells), ["row", "cell"]).groupBy(*items.columns).agg(F.min("n").alias("estimate"))


def sketch_sequential(rows: DataFrame, group: str, item: str, order: str, depth: int = 2, width: int = 1 << 12, conservative: bool = True) -> DataFrame:
    """group, item, estimate: a sketch of each group's whole numbers read in order, asked for each of them at
    the end. Conservative: only an item's least cells grow, which depends on the order, so groups must be bounded."""
    factors = [sketch_factors(r) for r in range(depth)]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        sketch = LinearCountMin(factors, SKETCH_PRIME, width, conservative)
        items = own.sort_values(order, kind="stable")[item].tolist()
        for x in items:
            sketch.increment(x)
        asked = sorted(set(items))
        return pd.DataFrame({group: [own[group].iloc[0]] * len(asked), item: asked, "estimate": [sketch.estimate(x) for x in asked]})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, item)}
    return rows.select(group, item, order).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, estimate long")


def gram_counts(rows: DataFrame, column: str, sizes: tuple[int, ...]) -> DataFrame:
    """size, code, n: how often each string of ``size`` bytes (up to 7, as a big-endian number) stands in the
    binary column. Grams are counted in each Arrow batch, so what is shuffled are partial counts, not bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column_ = batch.column(0).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column_.buffers()[1], np.int64)[column_.offset : column_.offset + len(column_) + 1]
            if not len(column_) or offsets[0] == offsets[-1]:
                continue
            data = np.frombuffer(column_.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            for start in range(0, len(data), GRAM_BYTES):
                part = data[start : start + GRAM_BYTES + max(sizes) - 1].astype(np.int64)
                at = np.arange(start, min(start + GRAM_BYTES, len(data)))
                room = offsets[np.searchsorted(offsets, at + offsets[0], side="right")] - offsets[0] - at
                for size in sizes:
                    starts = np.flatnonzero(room >= size)
                    code = np.zeros(len(starts), np.int64)
                    for j in range(size):
                        code = code << 8 | part[starts + j]
                    if size <= 2:
                        n = np.bincount(code, minlength=1)
                        code = np.flatnonzero(n)
                        n = n[code]
                    else:
                        code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), size, np.int32)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["size", "code", "n"])

    return rows.select(column).mapInArrow(count, "size int, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n"))


def gram_hex(size: Column, code: Column) -> Column:
    """A gram's bytes in hexadecimal."""
    return F.lpad(F.hex(code), (size * 2).cast("int"), F.lit("0"))
