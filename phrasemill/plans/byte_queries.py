"""Byte-level queries: scans, blocks, grams, sampling, fingerprints, ranks and suffixes; but for the counting of grams
without Python code on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions.bytes import as_bytes, bit_width, blocks, byte_rows, fingerprint, mod61, mulmod61, printable, slices
from phrasemill.operators.topk import gram_counts, gram_hex
from phrasemill.session import ship, spread, table

BLOCK = 4096


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select("doc_id", as_bytes("text").alias("b"))


def short_texts(spark: SparkSession, folder: str) -> DataFrame:
    """item_id and the whole text of every benchmark item, as text s and bytes b."""
    return table(spark, folder, "benchmark").select("item_id", F.col("text").alias("s"), as_bytes("text").alias("b"))


def short_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return byte_rows(short_texts(spark, folder), "b", "item_id")


def topk_grams_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most frequent 4-byte strings: the exact form of the bounded summaries."""
    ship(spark)
    grams = gram_counts(documents(spark, folder), "b", (4,)).orderBy(F.desc("n"), "code").limit(20)
    return grams.select(gram_hex(F.col("size"), F.col("code")).alias("gram"), F.col("n").alias("c")).orderBy(F.desc("c"), "gram")


def byte_histogram(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return gram_counts(documents(spark, folder), "b", (1,)).select(F.col("code").cast("int").alias("byte"), "n")


def byte_checksum(spark: SparkSession, folder: str) -> DataFrame:
    ones = documents(spark, folder).select("doc_id", F.explode(slices(F.col("b"), 1)).alias("one")).groupBy("doc_id", "one").count()
    value = F.conv(F.hex("one"), 16, 10).cast("long")
    return ones.groupBy("doc_id").agg(F.sum(value * F.col("count")).alias("checksum"))


def first_diff(spark: SparkSession, folder: str) -> DataFrame:
    """First differing byte of each document and the next: offset and line, or equal; a strict prefix
    differs where it ends. Blocks are compared first, then the bytes of one block only."""
    docs = documents(spark, folder)
    cut = blocks(docs, "b", BLOCK)
    left = cut.select("doc_id", "block_no", F.col("bytes").alias("x"))
    right = cut.select((F.col("doc_id") - 1).alias("doc_id"), "block_no", F.col("bytes").alias("y"))
    ids = docs.select("doc_id").join(docs.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    differ = left.join(right, ["doc_id", "block_no"], "full").join(ids, "doc_id", "left_semi").filter(~F.col("x").eqNullSafe(F.col("y")))
    first = differ.groupBy("doc_id").agg(F.min(F.struct("block_no", "x", "y")).alias("d")).select("doc_id", "d.*")
    x, y = F.coalesce("x", F.lit(b"")), F.coalesce("y", F.lit(b""))
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(x), F.octet_length(y)))
    at = F.array_min(F.filter(places, lambda p: F.substr(x, p, F.lit(1)) != F.substr(y, p, F.lit(1)))) - 1
    offset = first.select("doc_id", (F.col("block_no").cast("long") * BLOCK + at).alias("offset"))
    breaks = docs.join(offset, "doc_id").select("doc_id", "offset", F.substr("b", F.lit(1), F.col("offset").cast("int")).alias("head"))
    count = F.size(F.filter(slices(F.col("head"), 1), lambda one: F.hex(one) == "0A"))
    found = breaks.select("doc_id", "offset", (count + 1).cast("long").alias("line"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.col("offset").isNull().alias("equal"), "offset", "line")


def block_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Each block's length and least and greatest byte: the range that a fixed-universe code needs."""
    cut = blocks(documents(spark, folder), "b", BLOCK)
    bytes_ = slices(F.col("bytes"), 1)
    value = lambda one: F.conv(F.hex(one), 16, 10).cast("int")
    return cut.select("doc_id", "block_no", F.octet_length("bytes").alias("len"), value(F.array_min(bytes_)).alias("lo"), value(F.array_max(bytes_)).alias("hi"))


def block_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Bits of the fixed-universe binary code of each block, and the block's share of its document."""
    ranges = block_ranges(spark, folder)
    width = bit_width(F.col("hi") - F.col("lo"))
    return ranges.select("doc_id", "block_no", width.alias("width"), (width * F.col("len")).cast("long").alias("bits"))


def rank_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """rank(c, i), inclusive, of byte 'e' at every place, and of every place's own byte."""
    upto = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("item_id", "byte").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return short_bytes(spark, folder).select("item_id", "pos", F.sum((F.col("byte") == 101).cast("long")).over(upto).alias("rank_e"), F.count("*").over(own).alias("rank_own"))


def range_rank(spark: SparkSession, folder: str) -> DataFrame:
    """rank(i, j) of byte 'e' in every 16-byte range, as a difference of two ranks."""
    ranks = rank_prefix(spark, folder).select("item_id", "pos", "rank_e")
    before = F.coalesce(F.lag("rank_e", 16).over(Window.partitionBy("item_id").orderBy("pos")), F.lit(0))
    return ranks.select("item_id", "pos", (F.col("rank_e") - before).alias("in_range"))


def range_min(spark: SparkSession, folder: str) -> DataFrame:
    """Leftmost place of the least byte among each place and the 15 before."""
    near = Window.partitionBy("item_id").orderBy("pos").rowsBetween(-15, 0)
    least = F.min(F.struct("byte", "pos")).over(near)
    return short_bytes(spark, folder).select("item_id", "pos", least["byte"].alias("least"), least["pos"].alias("at"))


def _short_prints(spark: SparkSession, folder: str, size: int = 8) -> DataFrame:
    values = F.transform(slices(F.col("b"), 1), lambda one: F.conv(F.hex(one), 16, 10).cast("int"))
    texts = short_texts(spark, folder).filter(F.octet_length("b") >= size).select("item_id", values.alias("v"))
    starts = F.sequence(F.lit(1), F.size("v") - (size - 1))
    prints = F.transform(starts, lambda p: fingerprint(F.slice("v", p, size)))
    return texts.select("item_id", F.posexplode(prints).alias("pos", "fp")).select("item_id", F.col("pos").cast("long").alias("pos"), F.col("fp").cast("long").alias("fp"))


def kr_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _short_prints(spark, folder)


def sampled_grams(spark: SparkSession, folder: str) -> DataFrame:
    """8-byte strings whose fingerprint has its two low bits clear (a sample of one in four by content)."""
    return _short_prints(spark, folder).filter(F.col("fp").bitwiseAND(3) == 0)


def minimizers(spark: SparkSession, folder: str) -> DataFrame:
    """Places whose fingerprint is the least of the last eight."""
    near = Window.partitionBy("item_id").orderBy("pos").rowsBetween(-7, 0)
    return _short_prints(spark, folder).withColumn("least", F.min("fp").over(near)).filter("fp = least").select("item_id", "pos", "fp")


def _suffixes(spark: SparkSession, folder: str) -> DataFrame:
    texts = short_texts(spark, folder)
    starts = F.sequence(F.lit(0), F.octet_length("b") - 1)
    tails = F.transform(starts, lambda p: F.struct(p.cast("long").alias("pos"), F.substr(F.col("b"), p + 1).alias("tail"), F.substr(F.col("b"), p, F.lit(1)).alias("before")))
    rows = texts.filter(F.octet_length("b") > 0).select("item_id", F.explode(tails).alias("t")).select("item_id", "t.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("tail")).cast("long") - 1)


def suffix_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The inverse suffix array: the rank of every suffix in byte order."""
    return _suffixes(spark, folder).select("item_id", "pos", "rank")


def lcp(spark: SparkSession, folder: str) -> DataFrame:
    """Longest common prefix of each suffix with the one before it in order."""
    last = F.lag("tail").over(Window.partitionBy("item_id").orderBy("rank"))
    rows = _suffixes(spark, folder).withColumn("last", F.coalesce(last, F.lit(b"")))
    shorter = F.least(F.octet_length("tail"), F.octet_length("last"))
    differ = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda p: F.substr("tail", p, F.lit(1)) != F.substr("last", p, F.lit(1))))
    common = F.when(shorter == 0, 0).otherwise(F.coalesce(differ - 1, shorter))
    return rows.select("item_id", "rank", common.cast("long").alias("lcp"))


def bwt(spark: SparkSession, folder: str) -> DataFrame:
    """The Burrows-Wheeler transform by rank; the suffix of the whole text is preceded by nothing (-1)."""
    value = F.when(F.col("pos") == 0, -1).otherwise(F.conv(F.hex("before"), 16, 10).cast("int"))
    return _suffixes(spark, folder).select("item_id", "rank", value.alias("byte"))


def backward_search(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of 'th' and 'an' by two interval steps each: C[c] + rank(c, .) over the transform.
    The empty suffix, of rank -1, is the least one."""
    rows = bwt(spark, folder).select("item_id", (F.col("rank") + 1).alias("rank"), "byte")
    texts = short_texts(spark, folder).filter(F.octet_length("b") > 0)
    tail = texts.select("item_id", F.lit(0).cast("long").alias("rank"), F.conv(F.hex(F.substr("b", F.octet_length("b"), F.lit(1))), 16, 10).cast("int").alias("byte"))
    column = rows.unionByName(tail)
    counts = column.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "byte"))).alias("rows"),
        F.count("*").alias("n"),
    )  # at most an item's length of rows

    def rank(c: int, end: Column) -> Column:
        return F.size(F.filter(F.slice("rows", F.lit(1), F.greatest(end.cast("int"), F.lit(0))), lambda r: r["byte"] == c)).cast("long")

    def found(pattern: str) -> DataFrame:
        first, second = pattern.encode()
        low = F.size(F.filter("rows", lambda r: r["byte"] < second)).cast("long")
        high = low + F.size(F.filter("rows", lambda r: r["byte"] == second)).cast("long")
        staged = counts.withColumns({"low": low, "high": high})
        return staged.select("item_id", F.lit(pattern).alias("pattern"), (rank(first, F.col("high")) - rank(first, F.col("low"))).alias("n"))

    return found("th").unionByName(found("an"))


def length_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The five length classes 4..64 of the sampling parsers, and how many strings of each every document has."""
    n = F.octet_length("b")
    rows = documents(spark, folder).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class"))
    size = F.expr("shiftleft(1, class + 2)")
    return rows.select("doc_id", "class", size.alias("len"), F.greatest(F.col("n") - size + 1, F.lit(0)).cast("long").alias("strings"))


def length_overflow(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths as one token up to 255 and a remainder token beyond, with both tokens' widths in bits."""
    n = documents(spark, folder).select("doc_id", F.octet_length("b").cast("long").alias("n"))
    short, rest = F.least(F.col("n"), F.lit(255)), F.greatest(F.col("n") - 255, F.lit(0))
    return n.select("doc_id", short.alias("short"), rest.alias("rest"), F.ceil(F.col("n") / 255).alias("ceil_div"), bit_width(rest).alias("width"))


def printable_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return short_bytes(spark, folder).select("item_id", "pos", printable(F.col("byte")).alias("shown"))


def reversed_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Reversed texts, with a zero sentinel at the end."""
    return short_texts(spark, folder).select("item_id", F.concat(F.array_join(F.reverse(F.transform(slices(F.col("b"), 1), F.hex)), ""), F.lit("00")).alias("reversed"))


def alphabet_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes by their number in each item's effective alphabet."""
    number = F.dense_rank().over(Window.partitionBy("item_id").orderBy("byte")) - 1
    return short_bytes(spark, folder).select("item_id", "pos", number.cast("long").alias("symbol"))


def fingerprint_append(spark: SparkSession, folder: str) -> DataFrame:
    """fp(all) from fp(first half) and fp(second half): append is a multiplication and a sum."""
    values = F.transform(slices(F.col("b"), 1), lambda one: F.conv(F.hex(one), 16, 10).cast("int"))
    halves = short_texts(spark, folder).select("item_id", values.alias("v")).withColumn("h", F.floor(F.size("v") / 2).cast("int"))
    prints = halves.select(
        "item_id",
        fingerprint(F.col("v"), 256).alias("whole"),
        fingerprint(F.slice("v", F.lit(1), F.col("h")), 256).alias("a"),
        fingerprint(F.slice("v", F.col("h") + 1, F.size("v")), 256).alias("z"),
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("v") - F.col("h"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda p, _: mulmod61(p, F.lit(256))).alias("shift"),
    )
    joined = mod61((mulmod61(F.col("a"), F.col("shift")) + F.col("z")).cast("decimal(38,0)"))
    return prints.select("item_id", F.col("whole").cast("long").alias("whole"), joined.cast("long").alias("joined"))


def lce_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Longest common extension of places i and i + 7 within each item."""
    places = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 8, F.lit(0)))
    texts = short_texts(spark, folder).filter(F.octet_length("b") >= 8)

    def common(i: Column) -> Column:
        n = F.octet_length("b") - i - 7
        differ = F.array_min(F.filter(F.sequence(F.lit(1), n), lambda k: F.substr(F.col("b"), i + k, F.lit(1)) != F.substr(F.col("b"), i + 7 + k, F.lit(1))))
        return F.coalesce(differ - 1, n).cast("long")

    return texts.select("item_id", F.posexplode(F.transform(places, common)).alias("i", "lce")).select("item_id", F.col("i").cast("long").alias("i"), "lce")


def rst_functions(spark: SparkSession, folder: str) -> DataFrame:
    """For all 0 <= y < x <= 256: the highest bit in which x and y differ, and x with all lower bits cleared."""
    x = spark.range(1, 257).select(F.col("id").alias("x"))
    rows = x.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x") - 1)).alias("y"))
    top = bit_width(F.col("x").bitwiseXOR(F.col("y"))) - 1
    return rows.select("x", "y", top.alias("i"), F.call_function("shiftleft", F.call_function("shiftright", "x", top), top).alias("rst"))


def popcounts(spark: SparkSession, folder: str) -> DataFrame:
    """Set bits of each vec_id up to and including bit 7, and in bits 4..11."""
    ids = table(spark, folder, "embeddings").select("vec_id")
    return ids.select("vec_id", F.bit_count(F.col("vec_id").bitwiseAND(255)).cast("long").alias("low"), F.bit_count(F.col("vec_id").bitwiseAND(4080)).cast("long").alias("middle"))


def packed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of an item eight by eight, each eight packed into one (unsigned) number, and unpacked again."""
    starts = F.sequence(F.lit(1), F.octet_length("b"), F.lit(8))
    parts = F.transform(starts, lambda p: F.substr(F.col("b"), p, F.lit(8)))
    labels = short_texts(spark, folder).filter(F.octet_length("b") > 0).select("item_id", F.posexplode(parts).alias("label", "part"))
    packed = F.conv(F.hex("part"), 16, 10)
    return labels.select("item_id", "label", packed.alias("packed"), F.lower(F.lpad(F.conv(packed, 10, 16), (F.octet_length("part") * 2).cast("int"), F.lit("0"))).alias("unpacked"))


def reference_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 8-byte strings with their last earlier place: references shorter than a distance are
    counted as filtered, the others as kept."""
    grams = short_texts(spark, folder).select("item_id", F.posexplode(slices(F.col("b"), 4)).alias("pos", "g"))
    last = F.lag("pos").over(Window.partitionBy("item_id", "g").orderBy("pos"))
    refs = grams.withColumn("dist", F.col("pos") - last).filter("dist IS NOT NULL")
    return refs.groupBy("item_id").agg(F.count_if(F.col("dist") >= 16).alias("kept"), F.count_if(F.col("dist") < 16).alias("filtered"))


_BYTES = """y AS (SELECT item_id, unnest(regexp_extract_all(hex(encode(s)), '..')) h, generate_subscripts(regexp_extract_all(hex(encode(s)), '..'), 1) - 1 AS pos
  FROM (SELECT item_id, text s FROM benchmark)),
z AS (SELECT item_id, pos::BIGINT pos, ('0x' || h)::INTEGER AS byte FROM y)"""
_DOC_BYTES = """y AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS pos FROM documents)"""
_PRINTS = f"""{_BYTES},
v AS (SELECT item_id, list(byte ORDER BY pos) v FROM z GROUP BY item_id),
f AS (SELECT item_id, unnest(range(0, len(v) - 7)) AS pos, unnest(list_transform(range(0, len(v) - 7), lambda i: list_reduce(list_transform(v[i + 1:i + 8], lambda q: q::HUGEINT), lambda a, x: (a * 65497 + x) % 2305843009213693951::HUGEINT, 0::HUGEINT)))::BIGINT AS fp FROM v)"""
_TAILS = f"""{_BYTES},
t AS (SELECT item_id, hex(encode(s)) h FROM (SELECT item_id, text s FROM benchmark)),
u AS (SELECT item_id, unnest(range(0, (length(h) // 2)::BIGINT)) AS pos, h FROM t),
w AS (SELECT item_id, pos, substr(h, 2 * pos + 1) tail, h, row_number() OVER (PARTITION BY item_id ORDER BY substr(h, 2 * pos + 1)) - 1 AS rank FROM u)"""

ORACLE_SQL = {
    "topk_grams_exact": f"""WITH {_DOC_BYTES},
g AS (SELECT h || lead(h, 1) OVER w || lead(h, 2) OVER w || lead(h, 3) OVER w gram FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT gram, count(*) c FROM g WHERE gram IS NOT NULL GROUP BY 1 ORDER BY c DESC, gram LIMIT 20""",
    "byte_histogram": f"WITH {_DOC_BYTES} SELECT ('0x' || h)::INTEGER AS byte, count(*) n FROM y GROUP BY 1",
    "byte_checksum": f"WITH {_DOC_BYTES} SELECT doc_id, sum(('0x' || h)::INTEGER)::BIGINT AS checksum FROM y GROUP BY 1",
    "first_diff": f"""WITH {_DOC_BYTES},
p AS (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT * FROM y SEMI JOIN p USING (doc_id)), r AS (SELECT doc_id - 1 AS doc_id, pos, h FROM y WHERE doc_id - 1 IN (SELECT doc_id FROM p)),
d AS (SELECT doc_id, min(pos)::BIGINT AS pos FROM l FULL JOIN r USING (doc_id, pos) WHERE l.h IS DISTINCT FROM r.h GROUP BY 1),
n AS (SELECT d.doc_id, count(y.pos) + 1 AS line FROM d LEFT JOIN y ON y.doc_id = d.doc_id AND y.pos < d.pos AND y.h = '0A' GROUP BY 1)
SELECT doc_id, d.pos IS NULL AS equal, d.pos AS offset, line FROM p LEFT JOIN d USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "block_ranges": f"""WITH {_DOC_BYTES} SELECT doc_id, (pos // 4096)::INTEGER AS block_no, count(*)::INTEGER AS len, ('0x' || min(h))::INTEGER AS lo, ('0x' || max(h))::INTEGER AS hi FROM y GROUP BY 1, 2""",
    "block_bits": f"""WITH {_DOC_BYTES}, r AS (SELECT doc_id, (pos // 4096)::INTEGER AS block_no, count(*) n, ('0x' || max(h))::INTEGER - ('0x' || min(h))::INTEGER AS d FROM y GROUP BY 1, 2)
SELECT doc_id, block_no, CASE WHEN d = 0 THEN 0 ELSE length(bin(d)) END::INTEGER AS width, (n * CASE WHEN d = 0 THEN 0 ELSE length(bin(d)) END)::BIGINT AS bits FROM r""",
    "rank_prefix": f"""WITH {_BYTES} SELECT item_id, pos, sum((byte = 101)::BIGINT) OVER (PARTITION BY item_id ORDER BY pos)::BIGINT AS rank_e, count(*) OVER (PARTITION BY item_id, byte ORDER BY pos) AS rank_own FROM z""",
    "range_rank": f"""WITH {_BYTES} SELECT item_id, pos, sum((byte = 101)::BIGINT) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)::BIGINT AS in_range FROM z""",
    "range_min": f"""WITH {_BYTES}, m AS (SELECT item_id, pos, min(byte * 1000 + pos) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) m FROM z)
SELECT item_id, pos, (m // 1000)::INTEGER AS least, m % 1000 AS at FROM m""",
    "kr_fingerprints": f"WITH {_PRINTS} SELECT item_id, pos, fp FROM f",
    "sampled_grams": f"WITH {_PRINTS} SELECT item_id, pos, fp FROM f WHERE fp & 3 = 0",
    "minimizers": f"WITH {_PRINTS} SELECT item_id, pos, fp FROM f QUALIFY fp = min(fp) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
    "suffix_ranks": f"WITH {_TAILS} SELECT item_id, pos, rank FROM w",
    "lcp": f"""WITH {_TAILS}, l AS (SELECT item_id, rank, tail, coalesce(lag(tail) OVER (PARTITION BY item_id ORDER BY rank), '') last FROM w)
SELECT item_id, rank, coalesce(list_max(list_filter(range(0, least(length(tail), length(last)) // 2 + 1), lambda k: substr(tail, 1, 2 * k) = substr(last, 1, 2 * k))), 0)::BIGINT AS lcp FROM l""",
    "bwt": f"WITH {_TAILS} SELECT item_id, rank, CASE WHEN pos = 0 THEN -1 ELSE ('0x' || substr(h, 2 * pos - 1, 2))::INTEGER END AS byte FROM w",
    "backward_search": f"""WITH {_BYTES}, p AS (SELECT item_id, byte, lead(byte) OVER (PARTITION BY item_id ORDER BY pos) nxt FROM z), q AS (SELECT unnest(['th', 'an']) pattern)
SELECT item_id, pattern, count(*) FILTER (byte = ord(pattern[1]) AND nxt = ord(pattern[2])) AS n FROM p, q GROUP BY 1, 2""",
    "length_classes": """WITH n AS (SELECT doc_id, octet_length(encode(text)) n, unnest(range(0, 5)) c FROM documents)
SELECT doc_id, c::INTEGER AS "class", (1 << (c + 2))::INTEGER AS len, greatest(n - (1 << (c + 2)) + 1, 0)::BIGINT AS strings FROM n""",
    "length_overflow": """WITH n AS (SELECT doc_id, octet_length(encode(text))::BIGINT n FROM documents)
SELECT doc_id, least(n, 255) AS short, greatest(n - 255, 0) AS rest, ceil(n / 255)::BIGINT AS ceil_div, CASE WHEN n <= 255 THEN 0 ELSE length(bin(n - 255)) END::INTEGER AS width FROM n""",
    "printable_bytes": f"""WITH {_BYTES} SELECT item_id, pos, CASE WHEN byte BETWEEN 32 AND 126 THEN '''' || chr(byte) || '''' ELSE '0x' || lpad(upper(to_hex(byte)), 2, '0') END AS shown FROM z""",
    "reversed_bytes": f"""WITH {_BYTES} SELECT item_id, string_agg(h, '' ORDER BY pos DESC) || '00' AS reversed FROM y GROUP BY 1""",
    "alphabet_remap": f"WITH {_BYTES} SELECT item_id, pos, dense_rank() OVER (PARTITION BY item_id ORDER BY byte) - 1 AS symbol FROM z",
    "fingerprint_append": f"""WITH {_BYTES}, v AS (SELECT item_id, list(byte::HUGEINT ORDER BY pos) v FROM z GROUP BY item_id),
f AS (SELECT item_id, list_reduce(v, lambda a, x: (a * 256 + x) % 2305843009213693951::HUGEINT, 0::HUGEINT)::BIGINT AS whole FROM v)
SELECT item_id, whole, whole AS joined FROM f""",
    "lce_pairs": f"""WITH t AS (SELECT item_id, hex(encode(text)) h FROM benchmark), u AS (SELECT item_id, h, unnest(range(0, length(h) // 2 - 7)) i FROM t)
SELECT item_id, i, list_max(list_filter(range(0, length(h) // 2 - i - 6), lambda k: substr(h, 2 * i + 1, 2 * k) = substr(h, 2 * i + 15, 2 * k)))::BIGINT AS lce FROM u""",
    "rst_functions": """WITH r AS (SELECT x, unnest(range(0, x)) y FROM range(1, 257) t(x)), i AS (SELECT x, y, length(bin(xor(x, y))) - 1 AS i FROM r)
SELECT x, y, i::INTEGER AS i, (x >> i) << i AS rst FROM i""",
    "popcounts": "SELECT vec_id, bit_count(vec_id & 255)::BIGINT AS low, bit_count(vec_id & 4080)::BIGINT AS middle FROM embeddings",
    "packed_labels": """WITH t AS (SELECT item_id, hex(encode(text)) h FROM benchmark), p AS (SELECT item_id, unnest(range(0, (length(h) + 15) // 16)) AS label, h FROM t),
u AS (SELECT item_id, label::INTEGER AS label, substr(h, 16 * label + 1, 16) u FROM p) SELECT item_id, label, ('0x' || u)::UBIGINT::VARCHAR AS packed, lower(u) AS unpacked FROM u""",
    "reference_filters": f"""WITH {_BYTES}, g AS (SELECT item_id, pos, h || lead(h, 1) OVER w || lead(h, 2) OVER w || lead(h, 3) OVER w g FROM y WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
d AS (SELECT item_id, pos - lag(pos) OVER (PARTITION BY item_id, g ORDER BY pos) AS dist FROM g WHERE g IS NOT NULL)
SELECT item_id, count(*) FILTER (dist >= 16) AS kept, count(*) FILTER (dist < 16) AS filtered FROM d WHERE dist IS NOT NULL GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
