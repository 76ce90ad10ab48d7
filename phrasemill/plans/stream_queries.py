"""Streaming queries, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions.bytes import as_bytes
from phrasemill.operators.phrases import decode
from phrasemill.plans.summary_queries import ORACLE_SQL as SUMMARY_SQL
from phrasemill.session import ship, table
from phrasemill.streaming.summaries import last_of, run_to_end, staged, stream_table, streaming_blocks, streaming_lz78, streaming_lz78_decode, streaming_parse, streaming_topk

WINDOW = 256


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def stream_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Users of each event type by a stateful summary with room for all: exact counts."""
    ship(spark)
    rows = stream_table(spark, f"{folder}/events.parquet").select("event_type", "user_id", "event_id")
    found = run_to_end(streaming_topk(rows, "event_type", "user_id", "event_id", 1 << 20), _name("topk"), "update")
    return last_of(found, "event_type").select("event_type", "user_id", "n")


def stream_mg_aged(spark: SparkSession, folder: str) -> DataFrame:
    """One counter for each user, over events that come in three batches, with a cap of four: counts are evicted,
    saturate and are halved, and the state carries them from batch to batch."""
    ship(spark)
    rows = staged(table(spark, folder, "events").select("user_id", "event_type", "event_id"), "event_id", 3)
    found = run_to_end(streaming_topk(rows, "user_id", "event_type", "event_id", 1, max_freq=5), _name("aged"), "update")
    return last_of(found, "user_id").select("user_id", "event_type", "n")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their values in hourly windows."""
    rows = stream_table(spark, f"{folder}/events.parquet").select("ts", "event_type")
    hourly = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(hourly, _name("windows"), "complete").select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of documents through the LZ78 parser and back."""
    ship(spark)
    rows = stream_table(spark, f"{folder}/documents.parquet").select("doc_id", as_bytes("text").alias("b"))
    back = decode(streaming_parse(rows, "lz78"), "lz78").select("doc_id", F.decode("b", "UTF-8").alias("text"))
    return run_to_end(back, _name("roundtrip"), "append")


def _streams(spark: SparkSession, folder: str) -> DataFrame:
    """The items as eight texts that come in four batches."""
    ship(spark)
    items = table(spark, folder, "benchmark").select((F.col("item_id") % 8).alias("stream"), "item_id", as_bytes("text").alias("b"))
    return staged(items, "item_id", 4)


def _phrases(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """The phrases of the eight texts, an open one only if it is its text's last."""
    found = run_to_end(streaming_lz78(_streams(spark, folder), "stream", "b", "item_id", **options), _name("lz78"), "append")
    newest = F.max("seq").over(Window.partitionBy("stream"))
    longest = F.row_number().over(Window.partitionBy("stream", "seq").orderBy(F.desc("closed"), F.desc("batch")))
    return found.withColumns({"newest": newest, "longest": longest}).filter("longest = 1 AND (closed OR seq = newest)").select("stream", "seq", "ref", "len", "lit")


def stream_lz78(spark: SparkSession, folder: str) -> DataFrame:
    """LZ78 phrases of texts that come in pieces: dictionary and cursor live in the state."""
    return _phrases(spark, folder)


def stream_topk_lz78(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a bounded dictionary that has room for all: how many phrases, and bytes."""
    return _phrases(spark, folder, k=1 << 14).groupBy("stream").agg(F.count("*").alias("z"), F.sum("len").alias("n"))


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases streamed once more, and decoded with the dictionary in the state."""
    phrases = _phrases(spark, folder).withColumn("seq", F.col("seq"))
    back = run_to_end(streaming_lz78_decode(staged(phrases, "seq", 3), "stream"), _name("replay"), "append")
    parts = F.sort_array(F.collect_list(F.struct("seq", F.hex("b").alias("h"))))  # one text of a test's size
    return back.groupBy("stream").agg(F.array_join(F.transform(parts, lambda p: p["h"]), "").alias("bytes"))


def _windows(spark: SparkSession, folder: str, step: int) -> DataFrame:
    found = run_to_end(streaming_blocks(_streams(spark, folder), "stream", "b", "item_id", WINDOW, step), _name("blocks"), "append")
    best = F.row_number().over(Window.partitionBy("stream", "block_no").orderBy(F.desc(F.octet_length("bytes"))))
    return found.withColumn("best", best).filter("best = 1").select("stream", "block_no", "offset", F.hex("bytes").alias("bytes"))


def stream_byte_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows of WINDOW bytes over texts that come in pieces."""
    return _windows(spark, folder, WINDOW)


def stream_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of WINDOW bytes, one every half window."""
    return _windows(spark, folder, WINDOW // 2)


_TEXTS = "t AS (SELECT item_id % 8 AS stream, string_agg(hex(encode(text)), '' ORDER BY item_id) h FROM benchmark GROUP BY 1)"
_CHARS = f"{_TEXTS}, y AS (SELECT stream, unnest(regexp_extract_all(h, '..')) b, generate_subscripts(regexp_extract_all(h, '..'), 1) p FROM t), c AS (SELECT stream, string_agg(chr(256 + ('0x' || b)::INTEGER), '' ORDER BY p) s FROM y GROUP BY 1)"
_LZ78 = f"""WITH RECURSIVE {_CHARS}, f(stream, s, i, d, seq, len, ref, lit) AS (SELECT stream, s, 1::BIGINT, ['']::VARCHAR[], -1::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM c UNION ALL
  SELECT stream, s, i + least(l + 1, length(s) - i + 1), list_append(d, substr(s, i, l + 1)), seq + 1, least(l + 1, length(s) - i + 1), (list_position(d, substr(s, i, l)) - 1)::BIGINT,
    CASE WHEN i + l <= length(s) THEN unicode(substr(s, i + l, 1)) - 256 ELSE -1 END
  FROM (SELECT stream, s, i, d, seq, list_max(list_transform(list_filter(d, lambda w: starts_with(substr(s, i), w)), lambda w: length(w))) l FROM f WHERE i <= length(s)))"""


def _window_sql(step: int) -> str:
    """Windows that begin before the last whole one has been passed: of a sliding window those that begin
    before the text's end less what the window before already showed."""
    return f"""WITH {_TEXTS}, n AS (SELECT stream, h, length(h) // 2 n FROM t), b AS (SELECT stream, h, n, unnest(range(0, CASE WHEN n < {WINDOW} THEN (n > 0)::INTEGER ELSE (n - {WINDOW}) // {step} + 2 END)) AS block_no FROM n)
SELECT stream, block_no, block_no * {step} AS offset, substr(h, 2 * block_no * {step} + 1, {2 * WINDOW}) AS bytes FROM b WHERE block_no * {step} < n"""


ORACLE_SQL = {
    "stream_topk": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_mg_aged": SUMMARY_SQL["mg_aged"],
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_roundtrip": "SELECT doc_id, text FROM documents",
    "stream_lz78": f"{_LZ78} SELECT stream, seq, ref, len, lit FROM f WHERE seq >= 0",
    "stream_topk_lz78": f"{_LZ78} SELECT stream, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE seq >= 0 GROUP BY 1",
    "stream_replay": f"WITH {_TEXTS} SELECT stream, h AS bytes FROM t WHERE h <> ''",
    "stream_byte_windows": _window_sql(WINDOW),
    "stream_sliding_windows": _window_sql(WINDOW // 2),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
