"""Queries on phrase parsings, their decoders, statistics, codes and indexes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions.bytes import bit_width, blocks
from phrasemill.functions.sql import register
from phrasemill.operators import codec
from phrasemill.operators.container import compress, decompress
from phrasemill.operators.parsers import PARSERS, read_escaped, write_escaped
from phrasemill.operators.phrases import decode, decode_with, join_blocks, map_column, parse, parse_with, phrase_rows, round_trip, statistics
from phrasemill.operators.suffix_index import count_occurrences, runs, smaller_neighbours, suffix_array
from phrasemill.operators.summaries import PrefixSummary
from phrasemill.operators.topk import frequent_prefixes
from phrasemill.plans.byte_queries import _BYTES, documents, short_texts, suffix_ranks
from phrasemill.plans.byte_queries import ORACLE_SQL as ORACLE_SUFFIXES
from phrasemill.session import ship, stored

WINDOW = 4096
#: name of the query -> (parser, options)
ROUND_TRIPS: dict[str, tuple[str, dict]] = {
    "lz78_roundtrip": ("lz78", {}),
    "topk_lz78_roundtrip": ("topk_lz78", {"k": 512, "max_freq": 1024}),
    "topk_lz78_cm_roundtrip": ("topk_lz78", {"k": 512, "max_freq": 1024, "summary": "cm"}),
    "lz77_roundtrip": ("lz77", {}),
    "lpfs_roundtrip": ("lpfs", {"threshold": 4}),
    "topk_lz77_roundtrip": ("topk_lz77", {"k": 512, "window": WINDOW, "max_freq": 1024}),
    "topk_lz77_cm_roundtrip": ("topk_lz77", {"k": 512, "window": WINDOW, "max_freq": 1024, "summary": "cm"}),
    "twopass_roundtrip": ("twopass", {"k": 512}),
    "psample_roundtrip": ("psample", {}),
    "psample_cm_roundtrip": ("psample", {"summary": "cm"}),
    "sample_roundtrip": ("sample", {}),
    "sample_minimizers_roundtrip": ("sample", {"minimizers": True}),
    "sample_cm_roundtrip": ("sample", {"summary": "cm"}),
    "lzend_roundtrip": ("lzend", {}),
    "lzend_kk_roundtrip": ("lzend_kk", {"window": 256}),
    "lzend_kkl_roundtrip": ("lzend_kkl", {"window": 128}),
    "lzend_blockwise_roundtrip": ("lzend_blockwise", {"window": WINDOW}),
    "topk_lzend_roundtrip": ("topk_lzend", {"k": 512}),
    "topk_sel_roundtrip": ("topk_sel", {"k": 512}),
    "topk_weiner_roundtrip": ("topk_weiner", {"k": 512}),
    "topk_weiner_fast_roundtrip": ("topk_weiner_fast", {"k": 512}),
    "gzip9_roundtrip": ("gzip9", {}),
}
COVERS = {f"{a}_cover": (a, o) for a, o in (("lz78", {}), ("lz77", {}), ("topk_lz78", {"k": 512}), ("topk_lz77", {"k": 512, "window": WINDOW}), ("lzend", {}), ("attract", {}))}


def _texts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.select(key, F.decode("b", "UTF-8").alias("text"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return documents(spark, folder)


def _round_trip(algo: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _texts(round_trip(_docs(spark, folder), algo, **options))


def blockwise_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every block is parsed and decoded on its own; the blocks are put together again."""
    cut = blocks(_docs(spark, folder), "b", WINDOW).select("doc_id", "block_no", F.col("bytes").alias("b"))
    back = decode(parse(cut, "lz77"), "lz77")
    return _texts(documents(spark, folder).select("doc_id").join(join_blocks(back, "doc_id"), "doc_id", "left").withColumn("b", F.coalesce("b", F.lit(b""))))


def shared_dictionary_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes over the corpus: partial dictionaries add up to one of bounded size; the second pass
    parses all documents against it in parallel."""
    docs = _docs(spark, folder)
    strings = frequent_prefixes(docs, "b", 2048)
    return _texts(decode_with(parse_with(docs, strings), strings))


def _cover(algo: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        parsed = parse(_docs(spark, folder), algo, **options)
        total = F.aggregate("phrases", F.lit(0).cast("long"), lambda a, p: a + p["len"])
        return parsed.select("doc_id", total.alias("covered"))

    return run


def _counts(algo: str, **options: int) -> Callable[[SparkSession, str], DataFrame]:
    """Phrases of every item's whole bytes."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return parse(short_texts(spark, folder).select("item_id", "b"), algo, **options).select("item_id", F.size("phrases").cast("long").alias("z"), F.aggregate("phrases", F.lit(0).cast("long"), lambda a, p: a + p["len"]).alias("n"))

    return run


def phrase_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the LZ77 phrases of every item."""
    ship(spark)
    stats = statistics(parse(short_texts(spark, folder).filter(F.octet_length("b") > 0).select("item_id", "b"), "lz77", threshold=2), "item_id")
    return stats.select("item_id", "n_phrases", "n_refs", "n_literals", "longest", "total_len")


def phrase_at_position(spark: SparkSession, folder: str) -> DataFrame:
    """Random access through phrases: 40 bytes from every 1000th place, read from the static-dictionary
    phrases that overlap them. The phrase of a place is an as-of lookup: the last start at or before it."""
    docs = _docs(spark, folder)
    strings = frequent_prefixes(docs, "b", 512)
    rows = phrase_rows(parse_with(docs, strings), "doc_id")
    spelled = decode_with(
        rows.select("doc_id", "pos", "len", F.array(F.struct("kind", "ref", "src", "len", "lit")).alias("phrases")), strings
    )
    first = F.greatest(F.ceil((F.col("pos") - 39) / 1000), F.lit(0)) * 1000
    overlap = spelled.withColumn("at", F.explode(F.sequence(first.cast("long"), F.greatest(first.cast("long"), F.col("pos") + F.col("len") - 1), F.lit(1000).cast("long"))))
    overlap = overlap.filter("at < pos + len AND pos < at + 40")
    parts = overlap.groupBy("doc_id", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "b"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["b"])), "")
    skip = F.col("at") - F.col("parts")[0]["pos"]
    return parts.select("doc_id", F.col("at").alias("place"), F.substr(text, (skip * 2 + 1).cast("int"), F.lit(80)).alias("slice"))


def phrase_of_position(spark: SparkSession, folder: str) -> DataFrame:
    """As-of lookup of the LZ78 phrase that covers every 10th byte of an item: phrase starts and asked places
    in one ordered window instead of a range join."""
    ship(spark)
    items = short_texts(spark, folder).filter(F.octet_length("b") > 0).select("item_id", "b")
    phrase = F.struct("phrase_no", F.col("pos").alias("start"), "len")
    rows = phrase_rows(parse(items, "lz78"), "item_id").select("item_id", "pos", phrase.alias("phrase"), F.lit(False).alias("asked"))
    places = F.sequence(F.lit(0).cast("long"), F.octet_length("b").cast("long") - 1, F.lit(10).cast("long"))
    asked = items.select("item_id", F.explode(places).alias("pos"), F.lit(None).cast(rows.schema["phrase"].dataType).alias("phrase"), F.lit(True).alias("asked"))
    order = Window.partitionBy("item_id").orderBy("pos", "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asked).withColumn("phrase", F.last("phrase", ignorenulls=True).over(order)).filter("asked")
    return found.select("item_id", "pos", F.col("phrase.phrase_no").cast("long").alias("phrase_no"), "phrase.start", "phrase.len")


def _coded(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Bytes through an entropy coder and back."""
    coders: dict[str, tuple[Callable, Callable]] = {
        "huffman": (
            lambda b: codec.encode_block([(0, c) for c in b], {0: "huffman"})[0],
            lambda x: bytes(v for _, v in codec.decode_block(x, {0: "huffman"}, lambda _: 0)),
        ),
        "binary": (
            lambda b: codec.encode_block([(0, c) for c in b], {0: "binary"})[0],
            lambda x: bytes(v for _, v in codec.decode_block(x, {0: "binary"}, lambda _: 0)),
        ),
        "rans": (lambda b: codec.rans_encode(list(b)), lambda x: bytes(codec.rans_decode(x))),
        "vitter": (lambda b: codec.encode_adaptive(list(b)), lambda x: bytes(codec.decode_adaptive(x))),
    }
    encode, back = coders[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        cut = blocks(_docs(spark, folder), "b", 32768).select("doc_id", "block_no", F.col("bytes").alias("b"))
        coded = map_column(cut, "b", "code", "binary", lambda c: pa.array([encode(x) for x in c.to_pylist()], pa.binary()))
        plain = map_column(coded, "code", "b", "binary", lambda c: pa.array([back(x) for x in c.to_pylist()], pa.binary()))
        return _texts(documents(spark, folder).select("doc_id").join(join_blocks(plain, "doc_id"), "doc_id", "left").withColumn("b", F.coalesce("b", F.lit(b""))))

    return run


def _tokens(parsed: DataFrame, key: str, size: int) -> DataFrame:
    """key, block, type, value of the references and literals of LZ78 phrases, ``size`` phrases to a block."""
    phrases = parsed.select(key, F.posexplode("phrases").alias("seq", "p"))
    both = F.array(F.struct(F.lit("ref").alias("type"), F.col("p.ref").alias("value")), F.struct(F.lit("literal").alias("type"), F.col("p.lit").cast("long").alias("value")))
    return phrases.select(key, F.floor(F.col("seq") / size).alias("block"), F.explode(both).alias("t")).select(key, "block", "t.type", "t.value").filter("value >= 0")


def token_bits(spark: SparkSession, folder: str) -> DataFrame:
    """LZ78 phrases of the documents as tokens: count, range and fixed-width bits of each block and token type, natively."""
    tokens = _tokens(parse(_docs(spark, folder), "lz78"), "doc_id", 2048)
    stats = tokens.groupBy("doc_id", "block", "type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 2).alias("mean"))
    width = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.length(F.bin(F.col("hi") - F.col("lo"))))
    return stats.select("doc_id", "block", "type", "n", "lo", "hi", "mean", width.alias("width"), (width * F.col("n")).alias("bits"))


def _item_tokens(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return _tokens(parse(short_texts(spark, folder).select("item_id", "b"), "lz78"), "item_id", 64)


def item_token_bits(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the items, 64 phrases to a block, with the values' sum and sum of squares (the moments)."""
    value = F.col("value")
    stats = _item_tokens(spark, folder).groupBy("item_id", "block", "type").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    width = bit_width(F.col("hi") - F.col("lo"))
    return stats.select("item_id", "block", "type", "n", "lo", "hi", "total", "squares", width.alias("width"), (width * F.col("n")).cast("long").alias("bits"))


def item_token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens of each type have values of each binary width."""
    return _item_tokens(spark, folder).groupBy("item_id", "type", bit_width(F.col("value")).alias("width")).agg(F.count("*").alias("n"))


def huffman_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of each item's order-0 Huffman code."""
    ship(spark)
    short = short_texts(spark, folder).select("item_id", "b").filter(F.octet_length("b") > 0)
    return map_column(short, "b", "bits", "bigint", lambda c: pa.array([codec.huffman_bits(Counter(x)) for x in c.to_pylist()], pa.int64()))


def _runs(rows: DataFrame) -> DataFrame:
    """rows with the binary b replaced by its runs: start, period, length."""
    kind = "array<struct<start:bigint,period:bigint,length:bigint>>"
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "period", "length")]))
    found = map_column(rows, "b", "runs", kind, lambda c: pa.array([[dict(zip(("start", "period", "length"), r, strict=True)) for r in runs(x or b"")] for x in c.to_pylist()], arrow))
    return found.withColumn("r", F.explode("runs")).select(*[c for c in rows.columns if c != "b"], "r.*")


def maximal_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal repetitions (start, period, length) of every item, sorted and without repeats."""
    ship(spark)
    return _runs(short_texts(spark, folder).select("item_id", "b"))


def nearest_smaller(spark: SparkSession, folder: str) -> DataFrame:
    """For each place, the nearest suffixes in order before and after it that start earlier (-1: none)."""
    ship(spark)
    kind, arrow = "array<struct<before:bigint,after:bigint>>", pa.list_(pa.struct([("before", pa.int64()), ("after", pa.int64())]))
    near = lambda x: [{"before": a, "after": b} for a, b in zip(*smaller_neighbours(suffix_array(x)), strict=True)]
    found = map_column(short_texts(spark, folder).select("item_id", "b"), "b", "near", kind, lambda c: pa.array([near(x) for x in c.to_pylist()], arrow))
    return found.select("item_id", F.posexplode("near").alias("pos", "n")).select("item_id", F.col("pos").cast("long").alias("pos"), "n.*")


def pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of 'the' in every document by backward search over its transform."""
    found = map_column(_docs(spark, folder), "b", "n", "bigint", lambda c: pa.array([count_occurrences(x, b"the") for x in c.to_pylist()], pa.int64()))
    return found


def sql_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The LZ78 parsing as a table function in SQL."""
    ship(spark)
    register(spark)
    short_texts(spark, folder).select("item_id", "b").createOrReplaceTempView("phrasemill_short_texts")
    return spark.sql("SELECT item_id, p.phrase_no, p.pos, p.ref, p.len, p.lit FROM phrasemill_short_texts, LATERAL phrases(b, 'lz78') p")


def run_union(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the first and of the last two thirds of every item, at their places in the item, united without
    repeats: the sets share what lies in the middle third."""
    ship(spark)
    n = F.octet_length("b")
    third = F.floor(n / 3).cast("int")
    items = short_texts(spark, folder).select("item_id", "b")
    cut = lambda start, size: _runs(items.select("item_id", start.cast("long").alias("shift"), F.substr("b", start + 1, size).alias("b")))
    moved = lambda found: found.select("item_id", (F.col("start") + F.col("shift")).alias("start"), "period", "length")
    return moved(cut(F.lit(0), n - third)).unionByName(moved(cut(third, n - third))).distinct()


def encoded_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Every item through the container (magic, parameters, coded phrases) and back, by three algorithms, with
    the container's head and size."""
    ship(spark)
    items = short_texts(spark, folder).select("item_id", F.coalesce("b", F.lit(b"")).alias("b"))
    out = None
    for algo, options in (("lz77", {"threshold": 3}), ("lz78", {}), ("raw", {})):
        made = compress(items, algo, **options)
        back = decompress(made.withColumn("size", F.octet_length("payload")).withColumn("head", F.hex(F.substr("payload", F.lit(1), F.lit(8)))))
        part = back.select("item_id", F.lit(algo).alias("algo"), "head", (F.col("size") > 8).alias("has_payload"), F.decode("b", "UTF-8").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def container_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes in and out of the containers of all documents, by algorithm."""
    docs = _docs(spark, folder)
    out = None
    for algo, options in (("lz78", {}), ("lz77", {"threshold": 4}), ("topk_lz77", {"k": 512, "window": WINDOW, "max_freq": 1024})):
        made = compress(docs.withColumn("n", F.octet_length("b")), algo, **options)
        part = made.select(F.lit(algo).alias("algo"), "n", F.octet_length("payload").alias("nout"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("algo").agg(F.sum("n").alias("n"), F.sum("nout").alias("nout"), F.round(F.sum("nout") / F.sum("n"), 4).alias("ratio"))


def escaped_bytes_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as sampled phrases in the byte format with its escape byte, in windows, and back."""
    docs = _docs(spark, folder)
    pack = lambda x: write_escaped(PARSERS["windowed_psample"].encode(x, window=WINDOW))
    made = map_column(docs, "b", "out", "binary", lambda c: pa.array([pack(x or b"") for x in c.to_pylist()], pa.binary()))
    return _texts(map_column(made, "out", "b", "binary", lambda c: pa.array([PARSERS["psample"].decode(read_escaped(x)) for x in c.to_pylist()], pa.binary())))


def escaped_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the items in the byte format if nothing is copied: five bytes for an escape byte, one for others."""
    ship(spark)
    items = short_texts(spark, folder).select("item_id", F.regexp_replace("s", "[aeiou]", r"\$").alias("s")).select("item_id", F.encode("s", "UTF-8").alias("b"))
    return map_column(items, "b", "size", "bigint", lambda c: pa.array([len(write_escaped([("lit", -1, -1, 1, v) for v in x or b""])) for x in c.to_pylist()], pa.int64()))


def item_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the prefix summary of every item, with room for all: its strings and their counts."""
    ship(spark)

    def report(data: bytes) -> list[dict]:
        top = PrefixSummary(1 << 14, 1 << 20)
        state = top.EMPTY
        for c in data:
            state = top.extend(state, c)
            if not state[2]:
                state = top.EMPTY
        return [{"s": s.hex().upper(), "freq": n} for s, n in top.strings()]

    arrow = pa.list_(pa.struct([("s", pa.string()), ("freq", pa.int64())]))
    found = map_column(short_texts(spark, folder).select("item_id", "b"), "b", "strings", "array<struct<s:string,freq:bigint>>", lambda c: pa.array([report(x or b"") for x in c.to_pylist()], arrow))
    return found.select("item_id", F.explode("strings").alias("x")).select("item_id", "x.*")


def access_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of the parts of an item's random-access form: each phrase's reference, literal and start, at fixed widths."""
    ship(spark)
    items = short_texts(spark, folder).filter(F.octet_length("b") > 0).select("item_id", F.octet_length("b").cast("long").alias("n"), "b")
    parsed = parse(items, "lz78").select("item_id", "n", F.size("phrases").cast("long").alias("z"))
    z = F.col("z")
    return parsed.select("item_id", z, (z * bit_width(z)).alias("parent_bits"), (z * 8).alias("literal_bits"), (z * bit_width(F.col("n"))).alias("start_bits"))


def stored_suffix_index(spark: SparkSession, folder: str) -> DataFrame:
    """The items' suffix ranks written to the shared folder, read again, and put in order of rank: the suffix array."""
    return stored(suffix_ranks(spark, folder)).select("item_id", "rank", "pos")


_DOC_TEXT = "SELECT doc_id, text FROM documents"
_HEX = "h AS (SELECT item_id, hex(encode(text)) h FROM benchmark)"
#: items with a character for each byte, so that strings are compared byte by byte
_CHARS = f"""{_BYTES}, t AS (SELECT item_id id, string_agg(chr(256 + byte), '' ORDER BY pos) s FROM z GROUP BY item_id)"""
_LZ77 = f"""WITH RECURSIVE {_CHARS}, f(id, s, i, len, ref) AS (SELECT id, s, 1::BIGINT, 0::BIGINT, false FROM t UNION ALL
  SELECT id, s, i + CASE WHEN l < 2 THEN 1 ELSE l END, CASE WHEN l < 2 THEN 1 ELSE l END, l >= 2 FROM (SELECT id, s, i, (SELECT coalesce(max(q.l), 0)
    FROM range(2, length(s) - i + 2) q(l) WHERE instr(substr(s, 1, i + q.l - 2), substr(s, i, q.l)) > 0) l FROM f WHERE i <= length(s)))"""
_LZ78 = f"""WITH RECURSIVE {_CHARS}, f(id, s, i, d, pos, len, ref, lit) AS (SELECT id, s, 1::BIGINT, ['']::VARCHAR[], 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM t UNION ALL
  SELECT id, s, i + least(l + 1, length(s) - i + 1), list_append(d, substr(s, i, l + 1)), i - 1, least(l + 1, length(s) - i + 1), (list_position(d, substr(s, i, l)) - 1)::BIGINT,
    CASE WHEN i + l <= length(s) THEN unicode(substr(s, i + l, 1)) - 256 ELSE -1 END
  FROM (SELECT id, s, i, d, list_max(list_transform(list_filter(d, lambda w: starts_with(substr(s, i), w)), lambda w: length(w))) l FROM f WHERE i <= length(s))),
g AS (SELECT id AS item_id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS phrase_no, pos, ref, len, lit FROM f WHERE len > 0)"""
_TOKENS = f"""{_LZ78}, k AS (SELECT item_id, phrase_no // 64 AS block, 'ref' AS type, ref AS value FROM g UNION ALL SELECT item_id, phrase_no // 64, 'literal', lit FROM g WHERE lit >= 0)"""
_LZEND = f"""WITH RECURSIVE {_CHARS}, f(id, s, i, e, len) AS (SELECT id, s, 1::BIGINT, []::BIGINT[], 0::BIGINT FROM t UNION ALL
  SELECT id, s, i + l + 1, list_append(e, i + l), l + 1 FROM (SELECT id, s, i, e, coalesce(list_max(list_filter(range(1, length(s) - i + 1),
    lambda l: len(list_filter(e, lambda p: p >= l AND substr(s, p - l + 1, l) = substr(s, i, l))) > 0)), 0) l FROM f WHERE i <= length(s)))"""


#: the same of windows of 64 bytes, as items of their own
_WINDOWS = f"""{_BYTES}, a AS (SELECT item_id, string_agg(chr(256 + byte), '' ORDER BY pos) s FROM z GROUP BY item_id),
t AS (SELECT item_id * 1000 + w AS id, substr(s, 64 * w + 1, 64) s FROM (SELECT item_id, s, unnest(range(0, (length(s) + 63) // 64)) w FROM a))"""
_BY_ITEM = "SELECT id // 1000 AS item_id, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE len > 0 GROUP BY 1"


def _halves_sql() -> str:
    """Runs of both overlapping parts of the items."""
    part = """{0} AS (SELECT item_id, {1} AS shift, substr(h, 2 * ({1}) + 1, 2 * (length(h) // 2 - length(h) // 6)) h FROM h)"""
    return f"WITH {_HEX}, {part.format('a', '0')}, {part.format('o', 'length(h) // 6')}, c AS (SELECT * FROM a UNION ALL SELECT * FROM o)" + """,
b AS (SELECT item_id, shift, length(h) // 2 n, h, unnest(range(1, length(h) // 4 + 1)) p FROM c),
e AS (SELECT item_id, shift, n, p, unnest(range(0, n - p)) i, h FROM b), m AS (SELECT item_id, shift, p, i FROM e WHERE substr(h, 2 * i + 1, 2) = substr(h, 2 * (i + p) + 1, 2)),
g AS (SELECT item_id, shift, p, i, i - row_number() OVER (PARTITION BY item_id, shift, p ORDER BY i) k FROM m),
r AS (SELECT item_id, shift, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY item_id, shift, p, k HAVING count(*) >= p),
u AS (SELECT item_id, shift, start, min(p) AS period, length FROM r GROUP BY item_id, shift, start, length)
SELECT DISTINCT item_id, start + shift AS start, period, length FROM u"""


QUERIES = {name: _round_trip(*spec) for name, spec in ROUND_TRIPS.items()}
QUERIES |= {name: _cover(*spec) for name, spec in COVERS.items()}
QUERIES |= {f"{c}_roundtrip": _coded(c) for c in ("huffman", "binary", "rans", "vitter")}
QUERIES |= {"lz77_counts": _counts("lz77", threshold=2), "lz78_counts": _counts("lz78"), "topk_lz78_counts": _counts("topk_lz78", k=1 << 14, max_freq=1 << 20), "lzend_counts": _counts("lzend"), "lzend_kk_counts": _counts("lzend_kk"), "lzend_kkl_counts": _counts("lzend_kkl"), "blockwise_lz77_counts": _counts("blockwise_lz77", window=64), "lzend_blockwise_counts": _counts("lzend_blockwise", window=64)}
QUERIES |= {
    f.__name__: f
    for f in (
        blockwise_roundtrip, shared_dictionary_roundtrip, phrase_statistics, phrase_at_position, phrase_of_position, token_bits, item_token_bits, item_token_histogram, huffman_totals, maximal_runs, run_union, sql_phrases, nearest_smaller, pattern_counts, encoded_payload, container_ratios, escaped_bytes_roundtrip, escaped_literals, item_prefixes, access_sizes, stored_suffix_index,
    )
}

ORACLE_SQL = {name: _DOC_TEXT for name in QUERIES if name.endswith("_roundtrip")}
ORACLE_SQL |= {name: "SELECT doc_id, octet_length(encode(text))::BIGINT AS covered FROM documents" for name in COVERS}
ORACLE_SQL |= {
    "lzend_kk_counts": f"{_LZEND} SELECT id AS item_id, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE len > 0 GROUP BY id",
    "lzend_kkl_counts": f"{_LZEND} SELECT id AS item_id, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE len > 0 GROUP BY id",
    "escaped_literals": """SELECT item_id, (octet_length(encode(text)) + 4 * (octet_length(encode(regexp_replace(text, '[aeiou]', '$', 'g'))) - octet_length(encode(regexp_replace(text, '[aeiou$]', '', 'g')))))::BIGINT AS size FROM benchmark""",
    "item_prefixes": f"""{_LZ78}, p AS (SELECT g.item_id, substr(s, pos + 1, len) w FROM g JOIN t ON t.id = g.item_id), d AS (SELECT DISTINCT * FROM p),
c AS (SELECT d.item_id, d.w, count(*) freq FROM d JOIN p ON p.item_id = d.item_id AND starts_with(p.w, d.w) GROUP BY 1, 2)
SELECT item_id, list_reduce(list_transform(regexp_extract_all(w, '(?s).'), lambda x: printf('%02X', unicode(x) - 256)), lambda a, b: a || b) AS s, freq FROM c""",
    "access_sizes": f"""{_LZ78}, a AS (SELECT item_id, count(*) AS z, sum(len)::BIGINT n FROM g GROUP BY 1)
SELECT item_id, z, z * length(bin(z)) AS parent_bits, z * 8 AS literal_bits, z * length(bin(n)) AS start_bits FROM a""",
    "stored_suffix_index": ORACLE_SUFFIXES["suffix_ranks"],
    "lz77_counts": f"{_LZ77} SELECT id AS item_id, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE len > 0 GROUP BY id",
    "lz78_counts": f"{_LZ78} SELECT item_id, count(*) AS z, sum(len)::BIGINT AS n FROM g GROUP BY 1",
    "topk_lz78_counts": f"{_LZ78} SELECT item_id, count(*) AS z, sum(len)::BIGINT AS n FROM g GROUP BY 1",
    "lzend_counts": f"{_LZEND} SELECT id AS item_id, count(*) AS z, sum(len)::BIGINT AS n FROM f WHERE len > 0 GROUP BY id",
    "blockwise_lz77_counts": f"{_LZ77.replace(_CHARS, _WINDOWS)} {_BY_ITEM}",
    "lzend_blockwise_counts": f"{_LZEND.replace(_CHARS, _WINDOWS)} {_BY_ITEM}",
    "phrase_statistics": f"""{_LZ77} SELECT id AS item_id, count(*) AS n_phrases, count(*) FILTER (ref) AS n_refs, count(*) FILTER (NOT ref) AS n_literals, max(len) AS longest, sum(len)::BIGINT AS total_len
FROM f WHERE len > 0 GROUP BY id""",
    "phrase_at_position": """WITH h AS (SELECT doc_id, hex(encode(text)) h FROM documents), p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS place FROM h)
SELECT doc_id, place, substr(h, 2 * place + 1, 80) AS slice FROM p""",
    "phrase_of_position": f"""{_LZ78}, q AS (SELECT id AS item_id, unnest(range(0, length(s), 10)) AS pos FROM t)
SELECT q.item_id, q.pos, g.phrase_no, g.pos AS start, g.len FROM q JOIN g ON g.item_id = q.item_id AND g.pos <= q.pos AND q.pos < g.pos + g.len""",
    "item_token_bits": f"""{_TOKENS}, w AS (SELECT item_id, block, type, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value)::BIGINT AS total, sum(value * value)::BIGINT AS squares FROM k GROUP BY 1, 2, 3)
SELECT *, CASE WHEN hi = lo THEN 0 ELSE length(bin(hi - lo)) END::INTEGER AS width, (n * CASE WHEN hi = lo THEN 0 ELSE length(bin(hi - lo)) END)::BIGINT AS bits FROM w""",
    "item_token_histogram": f"{_TOKENS} SELECT item_id, type, CASE WHEN value = 0 THEN 0 ELSE length(bin(value)) END::INTEGER AS width, count(*) AS n FROM k GROUP BY 1, 2, 3",
    "huffman_totals": f"""WITH RECURSIVE {_BYTES}, l AS (SELECT item_id, list_sort(list(n)) l FROM (SELECT item_id, byte, count(*) n FROM z GROUP BY 1, 2) GROUP BY 1),
f(item_id, l, bits) AS (SELECT item_id, l, CASE WHEN len(l) = 1 THEN l[1] ELSE 0 END::BIGINT FROM l UNION ALL SELECT item_id, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM f WHERE len(l) > 1)
SELECT item_id, bits FROM f WHERE len(l) = 1""",
    "maximal_runs": f"""WITH {_HEX}, b AS (SELECT item_id, length(h) // 2 n, h, unnest(range(1, length(h) // 4 + 1)) p FROM h),
e AS (SELECT item_id, n, p, unnest(range(0, n - p)) i, h FROM b), m AS (SELECT item_id, p, i FROM e WHERE substr(h, 2 * i + 1, 2) = substr(h, 2 * (i + p) + 1, 2)),
g AS (SELECT item_id, p, i, i - row_number() OVER (PARTITION BY item_id, p ORDER BY i) k FROM m),
r AS (SELECT item_id, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY item_id, p, k HAVING count(*) >= p)
SELECT item_id, start, min(p) AS period, length FROM r GROUP BY item_id, start, length""",
    "sql_phrases": f"{_LZ78} SELECT item_id, phrase_no, pos, ref, len, lit FROM g",
    "run_union": _halves_sql(),
    "nearest_smaller": f"""WITH {_HEX}, u AS (SELECT item_id, unnest(range(0, length(h) // 2)) AS pos, h FROM h),
w AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY substr(h, 2 * pos + 1)) r FROM u)
SELECT a.item_id, a.pos, coalesce(max_by(b.pos, b.r) FILTER (b.r < a.r), -1) AS before, coalesce(min_by(b.pos, b.r) FILTER (b.r > a.r), -1) AS after
FROM w a LEFT JOIN w b ON a.item_id = b.item_id AND b.pos < a.pos GROUP BY 1, 2""",
    "pattern_counts": "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents",
    "encoded_payload": """WITH a AS (SELECT unnest([struct_pack(algo := 'lz77', head := '6C7A373700000000'), struct_pack(algo := 'lz78', head := '6C7A373800000000'), struct_pack(algo := 'raw', head := '7261770000000000')]) a)
SELECT item_id, a.algo AS algo, a.head AS head, true AS has_payload, text FROM benchmark, a""",
}
