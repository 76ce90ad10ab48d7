"""Columns of numbers and texts that travel between tasks as compressed blobs, dealt to buckets.

A task packs what it has for one bucket into one blob. With one level of dealing the number of blobs would be
tasks' batches times buckets, and both grow with the input; so beyond FAN buckets the blobs go to groups of
neighbouring buckets first, and are dealt again within each group.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

FAN = 512  # buckets that one level deals to
AGAIN_BYTES = 8 << 20  # packed bytes of a group that the second level takes at a time

DEALT = "bucket int, kind int, blob binary"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in an Arrow batch for what runs inside: bounds what a task holds of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """What this process has freed goes back to the system: Spark's Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library may be another one
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and give_back when it has taken all batches."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_of


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores before it as long as there is such a column (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte planes apart so that high bytes vanish, compressed."""
    return press(b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(unpress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes]


def unpack_all(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [unpack(b, columns) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * columns


def multikey_order(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order by all keys, and for each key whether a row differs from the one before in it or an
    earlier key. As in multikey quicksort, only rows that tie so far are compared by the next key."""
    order = np.argsort(keys[0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = keys[0][order[1:]] == keys[0][order[:-1]]
    new = [~same]
    for key in keys[1:]:
        tied = np.flatnonzero(same | np.append(same[1:], False))
        same = same.copy()
        if len(tied):
            rows, group = order[tied], np.cumsum(new[-1])[tied]
            rows = rows[np.lexsort((key[rows], group))]
            order[tied] = rows
            same[tied[1:]] &= key[rows[1:]] == key[rows[:-1]]
        new.append(~same)
    return order, new


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (second column) compressed, as they travel."""
    compressor = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [compressor.compress(x.as_buffer()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def open_text(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_buffer())


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def together(buckets: int) -> int:
    """How many neighbouring buckets are one for the first level."""
    return 1 if buckets <= FAN else min(FAN, -(-buckets // FAN))


def parts(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) for the bucket of each row."""
    order = np.argsort(place, kind="stable")
    own = place[order]
    cuts = np.flatnonzero(np.diff(own)) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(place[rows[0]]), rows


def dealt(rows: DataFrame, buckets: int, again: dict[int, Callable[[list[bytes]], Iterator[tuple[int, bytes]]]]) -> DataFrame:
    """Blobs (bucket, kind, blob) of the first level, in their buckets. again: of a kind, what parts blobs of a
    group into blobs of its buckets; kinds without it are results that may stay anywhere in their group."""
    each = together(buckets)
    if each == 1:
        return rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        size: dict[tuple[int, int], int] = defaultdict(int)

        def flush(group: int, kind: int) -> pa.RecordBatch:
            own = held.pop((group, kind))
            size.pop((group, kind), None)
            return batch([(b, kind, blob) for b, blob in again[kind](own)])

        for one in batches:
            for group, kind, blob in zip(*(one.column(i).to_pylist() for i in range(3)), strict=True):
                if kind not in again:
                    yield batch([(group * each, kind, blob)])
                    continue
                held[group, kind].append(blob)
                size[group, kind] += len(blob)
                if size[group, kind] >= AGAIN_BYTES or sum(size.values()) >= 4 * AGAIN_BYTES:
                    yield flush(*max(size, key=size.__getitem__))
        for group, kind in list(held):
            yield flush(group, kind)

    return rows.repartition(-(-buckets // each), "bucket").mapInArrow(deal, DEALT)
