"""Parsers and codecs over DataFrames: one row for each document (or block), phrases as an array column.

A parsing is sequential inside a document, so the unit of work is a document or a block of one; nothing is
shuffled to parse or decode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.operators import jvm
from phrasemill.operators.parsers import KINDS, PARSERS, Columns, Phrase, StaticTrie, decode_static, parse_static

PHRASES = "array<struct<kind:string,ref:bigint,src:bigint,len:bigint,lit:int>>"
_KIND = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("src", pa.int64()), ("len", pa.int64()), ("lit", pa.int32())])


def phrase_array(parsed: list[list[Phrase]]) -> pa.Array:
    """Arrow form of many parsings, built by columns."""
    flat = [p for phrases in parsed for p in phrases]
    columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parsed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def column_array(parsed: list[Columns]) -> pa.Array:
    """phrase_array of parsings by columns."""
    kind, *rest = (np.concatenate([getattr(p, f.name) for p in parsed]) if parsed else np.zeros(0, np.int8) for f in _KIND)
    names = pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int8)), pa.array(KINDS)).cast(pa.string())
    values = pa.StructArray.from_arrays([names, *(pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(rest, list(_KIND)[1:], strict=True))], fields=list(_KIND))
    offsets = np.concatenate([[0], np.cumsum([len(p.kind) for p in parsed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _columns(column: pa.Array) -> list[Columns]:
    values = column.flatten()
    kinds = pc.index_in(values.field(0), pa.array(KINDS)).to_numpy(zero_copy_only=False)
    fields = [kinds, *(values.field(i).to_numpy(zero_copy_only=False) for i in range(1, 5))]
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [Columns(*(f[a:b] for f in fields)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _phrases(column: pa.Array) -> list[list[Phrase]]:
    values = column.flatten()
    kinds = values.field(0).dictionary_encode()
    names = kinds.dictionary.to_pylist()
    numbers = [values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(1, 5)]
    flat = list(zip(map(names.__getitem__, kinds.indices.to_numpy(zero_copy_only=False).tolist()), *numbers, strict=True))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def map_column(rows: DataFrame, column: str, out: str, kind: str, run: Callable[[pa.Array], pa.Array], size: int = 256) -> DataFrame:
    """rows with ``column`` replaced by ``out``, a function of up to ``size`` rows of Arrow batches; other columns pass."""
    kept = [c for c in rows.columns if c != column]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):  # bounds what Python objects take at a time
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), run(part.column(len(kept)))], [*kept, out])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, column).mapInArrow(mapped, f"{types}, `{out}` {kind}")


def _parser(algo: str, options: dict) -> Callable[[pa.Array], pa.Array]:
    parser = PARSERS[algo]
    if parser.columns:
        return lambda c: column_array([parser.columns(x or b"", **options) for x in c.to_pylist()])
    return lambda c: phrase_array([parser.encode(x or b"", **options) for x in c.to_pylist()])


def _decoder(algo: str, options: dict) -> Callable[[pa.Array], pa.Array]:
    parser = PARSERS[algo]
    if parser.decode is None:
        raise ValueError(f"{algo} is a statistics-only parsing")
    if parser.back:
        return lambda c: pa.array([parser.back(p, **options) for p in _columns(c)], pa.binary())
    return lambda c: pa.array([parser.decode(p, **options) for p in _phrases(c)], pa.binary())


def parse(rows: DataFrame, algo: str, column: str = "b", **options: Any) -> DataFrame:
    """rows with the binary column replaced by ``phrases``. A null parses as empty."""
    return map_column(rows, column, "phrases", PHRASES, _parser(algo, options))


def decode(parsed: DataFrame, algo: str, **options: Any) -> DataFrame:
    """The inverse of parse: ``phrases`` replaced by the binary column ``b``."""
    return map_column(parsed, "phrases", "b", "binary", _decoder(algo, options))


def round_trip(rows: DataFrame, algo: str, column: str = "b", **options: Any) -> DataFrame:
    """decode(parse(rows)): the same phrases as an array column, which does not leave the task's Python between; those of
    the selective parser do not leave the JVM."""
    if algo == "topk_sel" and jvm.fits(**options):
        return jvm.selective_decode(jvm.selective_parse(rows, column, **options), **options)
    there, back = _parser(algo, options), _decoder(algo, options)
    return map_column(rows, column, "b", "binary", lambda c: back(there(c)), 32)


def parse_with(rows: DataFrame, strings: list[bytes], column: str = "b") -> DataFrame:
    """Greedy parsing against a frozen dictionary of bounded size, which travels with the tasks."""
    trie = StaticTrie(strings)
    return map_column(rows, column, "phrases", PHRASES, lambda c: phrase_array([parse_static(x or b"", trie) for x in c.to_pylist()]))


def decode_with(parsed: DataFrame, strings: list[bytes]) -> DataFrame:
    trie = StaticTrie(strings)
    return map_column(parsed, "phrases", "b", "binary", lambda c: pa.array([decode_static(p, trie) for p in _phrases(c)], pa.binary()))


def phrase_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """keys, phrase_no, pos, kind, ref, src, len, lit. pos is the sum of the lengths before."""
    rows = parsed.select(*keys, F.posexplode("phrases").alias("phrase_no", "p")).select(*keys, "phrase_no", "p.*")
    before = Window.partitionBy(*keys).orderBy("phrase_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pos", F.coalesce(F.sum("len").over(before), F.lit(0)))


def statistics(parsed: DataFrame, *keys: str) -> DataFrame:
    """Phrase statistics of each row: all, references, literals, longest, furthest, averages over
    references rounded to two places (null if there are none)."""
    p = F.col("phrases")
    refs = F.filter(p, lambda x: x["kind"] != "lit")
    total = lambda xs, f: F.aggregate(F.transform(xs, lambda x: x[f]), F.lit(0).cast("long"), lambda a, n: a + n)
    mean = lambda xs, f: F.when(F.size(xs) > 0, F.round(total(xs, f) / F.size(xs), 2))
    return parsed.select(
        *keys,
        F.size(p).cast("long").alias("n_phrases"),
        F.size(refs).cast("long").alias("n_refs"),
        (F.size(p) - F.size(refs)).cast("long").alias("n_literals"),
        F.array_max(F.transform(p, lambda x: x["len"])).alias("longest"),
        F.array_max(F.transform(refs, lambda x: x["src"])).alias("furthest"),
        total(p, "len").alias("total_len"),
        mean(refs, "len").alias("avg_ref_len"),
        mean(refs, "src").alias("avg_dist"),
    )


def join_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """Blocks (keys, block_no, b) put together again; a document's blocks are as many as it is long."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_no", "b"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            bytes_ = column.flatten().field(1).to_pylist()
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).tolist()
            out = [b"".join(bytes_[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.binary())], [*keys, "b"])

    return parts.mapInArrow(joined, f"{kinds}, b binary")
