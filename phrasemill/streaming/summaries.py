"""Bounded summaries and parsers over unbounded streams (Structured Streaming).

State is one summary for each stream key: at most k counters, however long the stream is. Rows of a
micro-batch are put in order of their position; a position that falls from batch to batch is refused. A key is
one text or stream, read in order, so one key's work is one task's; keys are independent.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phrasemill.operators.phrases import parse
from phrasemill.operators.summaries import PrefixSummary, SketchStrings, StringSummary
from phrasemill.session import ensure_checkpoints


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read from the files."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a single file too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(pattern)


def streaming_topk(rows: DataFrame, key: str, item: str, position: str, k: int, max_freq: int = 1 << 30, kind: str = "mg") -> DataFrame:
    """key, batch, item, n: after each micro-batch, every changed stream's summary (update mode)."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, summary, last = pickle.loads(state.get[0]) if state.exists else (0, StringSummary(k, max_freq) if kind == "mg" else SketchStrings(k), None)
        own = _in_order(parts, position, last)
        for x in own[item].tolist():
            summary.insert(x)
        state.update((pickle.dumps((batch + 1, summary, own[position].iloc[-1])),))
        found = summary.report()
        yield pd.DataFrame({key: [group[0]] * len(found), "batch": [batch] * len(found), item: [i for i, _ in found], "n": [n for _, n in found]})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, item)}
    out = f"`{key}` {kinds[key]}, batch long, `{item}` {kinds[item]}, n long"
    return rows.select(key, item, position).groupBy(key).applyInPandasWithState(run, out, "summary binary", "update", GroupStateTimeout.NoTimeout)


def streaming_prefixes(rows: DataFrame, key: str, data: str, position: str, k: int, max_freq: int = 1 << 30) -> DataFrame:
    """key, batch, s, n: the bounded dictionary of prefixes after each micro-batch. The cursor inside the
    dictionary is carried over in the state, so a stream may be cut into rows anywhere."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, top, cursor, last = pickle.loads(state.get[0]) if state.exists else (0, PrefixSummary(k, max_freq), PrefixSummary.EMPTY, None)
        own = _in_order(parts, position, last)
        for text in own[data].tolist():
            for c in text or b"":
                cursor = top.extend(cursor, c)
                if not cursor[2]:
                    cursor = top.EMPTY
        state.update((pickle.dumps((batch + 1, top, cursor, own[position].iloc[-1])),))
        found = top.strings()
        yield pd.DataFrame({key: [group[0]] * len(found), "batch": [batch] * len(found), "s": [s for s, _ in found], "n": [n for _, n in found]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, data, position).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, batch long, s binary, n long", "summary binary", "update", GroupStateTimeout.NoTimeout)


def streaming_parse(rows: DataFrame, algo: str, column: str = "b", **options: Any) -> DataFrame:
    """Documents of a stream parsed as they come: stateless. One long text that is cut into rows is for
    streaming_lz78."""
    return parse(rows, algo, column, **options)


def _in_order(parts: Iterator[pd.DataFrame], position: str, last: Any) -> pd.DataFrame:
    """The rows of a batch by position; a position below that of an earlier batch is refused."""
    own = pd.concat(list(parts)).sort_values(position, kind="stable")
    if last is not None and len(own) and own[position].iloc[0] < last:
        raise ValueError(f"position {own[position].iloc[0]} came after {last}")
    return own


def streaming_lz78(rows: DataFrame, key: str, data: str, position: str, k: int | None = None, max_freq: int = 1 << 20) -> DataFrame:
    """key, batch, seq, ref, len, lit, closed: each stream's text, however it is cut into rows, parsed into LZ78
    phrases; the dictionary and the cursor in it are carried over in the state. With k the dictionary is
    bounded (the top-k parser). The phrase that is open when a batch ends comes with closed = false and without a
    byte, and comes again when it grows; only the last batch's counts."""

    def fresh() -> tuple:
        top = None if k is None else PrefixSummary(k, max_freq)
        return 0, 0, None, top, {} if top is None else None, (0, 0) if top is None else top.EMPTY

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, seq, last, top, child, cursor = pickle.loads(state.get[0]) if state.exists else fresh()
        own = _in_order(parts, position, last)
        out = []
        for text in own[data].tolist():
            for c in text or b"":
                if top is None:
                    nxt = child.get(cursor[0] << 8 | c)
                    if nxt is None:
                        child[cursor[0] << 8 | c] = seq + 1
                    step, cursor_, empty = nxt is not None, (nxt, cursor[1] + 1), (0, 0)
                else:
                    cursor_ = top.extend(cursor, c)
                    step, empty = bool(cursor_[2]), top.EMPTY
                if step:
                    cursor = cursor_
                else:
                    out.append((seq, cursor[0], cursor[1] + 1, c, True))
                    seq, cursor = seq + 1, empty
        last = own[position].iloc[-1] if len(own) else last
        state.update((pickle.dumps((batch + 1, seq, last, top, child, cursor)),))
        if cursor[1]:
            out.append((seq, cursor[0], cursor[1], -1, False))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pd.DataFrame({key: [group[0]] * len(out), "batch": [batch] * len(out)} | dict(zip(("seq", "ref", "len", "lit", "closed"), columns, strict=True)))

    kind = rows.schema[key].dataType.simpleString()
    out_type = f"`{key}` {kind}, batch long, seq long, ref long, len long, lit int, closed boolean"
    return rows.select(key, data, position).groupBy(key).applyInPandasWithState(run, out_type, "parser binary", "append", GroupStateTimeout.NoTimeout)


def streaming_lz78_decode(phrases: DataFrame, key: str) -> DataFrame:
    """key, seq, b: the bytes of each stream's closed phrases (seq, ref, lit), replayed with the dictionary in
    the state; phrases must come in order of seq from batch to batch."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        texts = pickle.loads(state.get[0]) if state.exists else [b""]
        own = _in_order(parts, "seq", len(texts) - 1)
        start = len(texts)
        for seq, ref, lit in zip(own["seq"].tolist(), own["ref"].tolist(), own["lit"].tolist(), strict=True):
            if seq != len(texts) - 1:
                raise ValueError(f"phrase {len(texts) - 1} is missing")
            texts.append(texts[ref] + (bytes([lit]) if lit >= 0 else b""))
        state.update((pickle.dumps(texts),))
        yield pd.DataFrame({key: [group[0]] * len(own), "seq": range(start - 1, len(texts) - 1), "b": texts[start:]})

    kind = phrases.schema[key].dataType.simpleString()
    return phrases.select(key, "seq", "ref", "lit").groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, seq long, b binary", "texts binary", "append", GroupStateTimeout.NoTimeout)


def streaming_blocks(rows: DataFrame, key: str, data: str, position: str, window: int, step: int | None = None) -> DataFrame:
    """key, block_no, offset, bytes, closed: windows of ``window`` bytes of each stream's text, however it is cut
    into rows: tumbling, or sliding by ``step`` bytes. The state is less than a window of bytes. The block that is
    open when a batch ends comes with closed = false, and again when it is full."""
    step = step or window

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held, last = pickle.loads(state.get[0]) if state.exists else (0, b"", None)
        own = _in_order(parts, position, last)
        held += b"".join(x or b"" for x in own[data].tolist())
        out = []
        while len(held) >= window:
            out.append((number, number * step, held[:window], True))
            number, held = number + 1, held[step:]
        state.update((pickle.dumps((number, held, own[position].iloc[-1] if len(own) else last)),))
        if held:
            out.append((number, number * step, held, False))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pd.DataFrame({key: [group[0]] * len(out)} | dict(zip(("block_no", "offset", "bytes", "closed"), columns, strict=True)))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, data, position).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, block_no long, offset long, bytes binary, closed boolean", "block binary", "append", GroupStateTimeout.NoTimeout)


def staged(rows: DataFrame, position: str, parts: int) -> DataFrame:
    """A bounded table as a stream of ``parts`` batches in order of position, through files in the shared
    checkpoint folder (for tests and demos)."""
    ensure_checkpoints(rows.sparkSession)
    path = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    numbered = rows.withColumn("__part", F.ntile(parts).over(Window.orderBy(position)))
    kept = numbered.persist()
    for number in range(1, parts + 1):
        kept.filter(F.col("__part") == number).drop("__part").coalesce(1).write.mode("append").parquet(path)
    kept.unpersist()
    return stream_table(rows.sparkSession, path)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there now, through Parquet files in the shared checkpoint folder: each batch's rows, of a
    complete result the last batch's."""
    spark = stream.sparkSession
    ensure_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{name}"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = batches[-1:] if mode == "complete" else batches
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{base}/batch-{n}" for n in dict.fromkeys(kept)))


def last_of(found: DataFrame, key: str) -> DataFrame:
    """The rows of each stream's last batch."""
    newest = F.max("batch").over(Window.partitionBy(key))
    return found.withColumn("newest", newest).filter("batch = newest").drop("batch", "newest")
