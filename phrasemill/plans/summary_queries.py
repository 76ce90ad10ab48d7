"""Queries on bounded summaries, sketches and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.functions.bytes import as_bytes, slices
from phrasemill.operators.topk import gram_counts, gram_hex, sketch_cells, sketch_estimates, sketch_factors, sketch_sequential, SKETCH_PRIME, topk_exact, topk_mergeable, topk_sequential
from phrasemill.plans.byte_queries import documents, short_texts
from phrasemill.session import ship, stored, table


CELLS, FEW_CELLS = 256, 16  # of a row of the sketches
SLICE = 4096  # events that a sequential summary reads; a table has as many as it takes


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events, in streams of SLICE successive ones."""
    ship(spark)
    return table(spark, folder, "events").select("event_id", "event_type", "user_id", F.floor(F.col("event_id") / SLICE).alias("stream"))


def mg_events(spark: SparkSession, folder: str) -> DataFrame:
    """With as many counters as distinct items the sequential summaries are exact, and so is their sum."""
    return topk_sequential(events(spark, folder), "stream", "event_type", "event_id", 64).groupBy("event_type").agg(F.sum("n").alias("n"))


def mg_users(spark: SparkSession, folder: str) -> DataFrame:
    """Exact counts of each event type's users, from summaries with room for all of a stream's."""
    rows = events(spark, folder).withColumn("pair", F.concat_ws("|", "user_id", "event_type"))
    found = topk_sequential(rows, "stream", "pair", "event_id", SLICE).groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select(F.substring_index("pair", "|", 1).cast("long").alias("user_id"), F.expr("substr(pair, instr(pair, '|') + 1)").alias("event_type"), "n")


def mg_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Few counters: every count is within N / (k + 1) below the truth, over all streams."""
    rows = events(spark, folder)
    true = rows.groupBy("user_id").agg(F.count("*").alias("t"))
    total = rows.agg(F.count("*").alias("total"))
    found = topk_sequential(rows, "stream", "user_id", "event_id", 32).groupBy("user_id").agg(F.sum("n").alias("n"))
    joined = true.join(found, "user_id", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return joined.select("user_id", ((n <= F.col("t")) & (F.col("t") <= n + F.col("total") / 33)).alias("within"))


def mg_one_counter(spark: SparkSession, folder: str) -> DataFrame:
    """One counter for each user's event types: items are evicted all the time."""
    return topk_sequential(events(spark, folder), "user_id", "event_type", "event_id", 1).select("user_id", "event_type", "n")


def mg_aged(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a cap of four: counts saturate, and are halved when the threshold reaches half the cap."""
    return topk_sequential(events(spark, folder), "user_id", "event_type", "event_id", 1, max_freq=5).select("user_id", "event_type", "n")


def mg_merged_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The mergeable form keeps its stated error."""
    rows = events(spark, folder)
    true = rows.groupBy("user_id").agg(F.count("*").alias("t"))
    found = topk_mergeable(rows, "user_id", 100)
    ok = (F.col("n") <= F.col("t")) & (F.col("t") <= F.col("n") + F.col("error"))
    return found.join(true, "user_id").agg(F.min(ok).alias("within"))


def mg_merged_exact(spark: SparkSession, folder: str) -> DataFrame:
    return topk_mergeable(events(spark, folder), "event_type", 64).select("event_type", "n", "error")


def builtin_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The engine's own mergeable sketch of frequent items."""
    best = events(spark, folder).agg(F.expr("approx_top_k(event_type, 3, 1000)").alias("top"))
    return best.select(F.explode("top").alias("t")).select(F.col("t.item").alias("event_type"), F.col("t.count").alias("n"))


def topk_users(spark: SparkSession, folder: str) -> DataFrame:
    return topk_exact(events(spark, folder), "user_id", 10)


def cm_upper(spark: SparkSession, folder: str) -> DataFrame:
    """Sketch estimates, and how far above the truth they are (never below)."""
    rows = events(spark, folder)
    item = F.col("user_id")
    true = rows.groupBy("user_id").agg(F.count("*").alias("t"))
    found = sketch_estimates(true, item, sketch_cells(rows, item, width=CELLS), width=CELLS)
    return found.select("user_id", "estimate", (F.col("estimate") - F.col("t")).alias("above"))


def cm_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the sketch: each row's sum, largest cell, sum of squares and empty cells."""
    cells = sketch_cells(events(spark, folder), F.col("user_id"), width=CELLS)
    n = F.col("n")
    return cells.groupBy("row").agg(F.sum(n).alias("total"), F.max(n).alias("largest"), F.sum(n * n).alias("squares"), (CELLS - F.count("*")).alias("zeros"))


def cm_conservative(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates of a small conservative sketch of each stream's users, which collide all the time."""
    return sketch_sequential(events(spark, folder), "stream", "user_id", "event_id", width=FEW_CELLS)


def population(spark: SparkSession, folder: str) -> DataFrame:
    """How many users have each count."""
    counts = events(spark, folder).groupBy("user_id").agg(F.count("*").alias("freq"))
    return counts.groupBy("freq").agg(F.count("*").alias("items"))


def extract_min(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n")).orderBy("n", "user_id").limit(1)


def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 most frequent strings of each length 1..4 in the documents: bounded by 800 rows. One scan, one
    aggregation of partial counts."""
    ship(spark)
    counts = gram_counts(documents(spark, folder), "b", (1, 2, 3, 4))
    best = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "code"))
    kept = counts.withColumn("place", best).filter("place <= 200")
    return kept.select(gram_hex(F.col("size"), F.col("code")).alias("s"), F.col("size").alias("depth"), F.col("n").alias("freq"))


def dictionary_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the items' 4-byte strings that stand in the dictionary: a hash probe of a bounded table."""
    grams = short_texts(spark, folder).select("item_id", F.posexplode(slices(F.col("b"), 4)).alias("pos", "g")).select("item_id", F.col("pos").cast("long").alias("pos"), F.hex("g").alias("s"))
    own = _dictionary(spark, folder).filter("depth = 4")
    return grams.join(F.broadcast(own), "s").select("item_id", "pos", "s", "freq")


def longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary's longest match at every place: one equi-join over all depths, not a prefix join."""
    grams = F.array(*(F.transform(slices(F.col("b"), size), lambda g: F.hex(g)) for size in (1, 2, 3, 4)))
    hits = short_texts(spark, folder).select("item_id", F.explode(grams).alias("gs")).select("item_id", F.posexplode("gs").alias("pos", "s"))
    found = hits.join(F.broadcast(_dictionary(spark, folder)), "s")
    return found.groupBy("item_id", F.col("pos").cast("long").alias("pos")).agg(F.max("depth").alias("depth"))


def suffix_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each dictionary string with the dictionary string that lacks its first byte."""
    own = _dictionary(spark, folder)
    shorter = own.select(F.col("s").alias("link"))
    return own.filter("depth > 1").select("s", F.substring("s", 3, 6).alias("link")).join(shorter, "link").select("s", "link")


def _trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all items, whole: s (hex), depth, freq (items below it)."""
    items = short_texts(spark, folder).filter(F.octet_length("b") > 0)
    heads = F.transform(F.sequence(F.lit(1), F.octet_length("b")), lambda d: F.struct(F.hex(F.substr(F.col("b"), F.lit(1), d)).alias("s"), d.alias("depth")))
    return items.select(F.explode(heads).alias("h")).groupBy("h.s", "h.depth").agg(F.count("*").alias("freq"))


def trie_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edge table: (parent, label) -> node, children by label."""
    nodes = _trie(spark, folder)
    label = F.conv(F.substring("s", -2, 2), 16, 10).cast("int")
    return nodes.select("s", F.expr("substring(s, 1, length(s) - 2)").alias("parent"), label.alias("label"), "depth", "freq", (F.row_number().over(Window.partitionBy(F.expr("substring(s, 1, length(s) - 2)")).orderBy(label)) - 1).cast("long").alias("index"))


def trie_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, leaves, inner nodes' degrees, and arms (leaves that are only children)."""
    nodes = trie_edges(spark, folder)
    degree = nodes.groupBy("parent").agg(F.count("*").alias("degree"))
    joined = nodes.join(degree.withColumnRenamed("parent", "s"), "s", "left").join(degree.select("parent", F.col("degree").alias("siblings")), "parent")
    leaf = F.col("degree").isNull()
    return joined.agg(
        F.count("*").alias("nodes"), F.count_if(leaf).alias("leaves"), F.max("degree").alias("max_degree"), F.sum(F.coalesce("degree", F.lit(0))).alias("inner_degree"), F.count_if(leaf & (F.col("siblings") == 1)).alias("arms")
    )


def trie_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Arms of the trie: tails that do not branch, from the last node with two children (or the root) to a
    leaf. How many, their length together, and the longest."""
    nodes = stored(_trie(spark, folder))
    parent = F.expr("substring(s, 1, length(s) - 2)")
    degree = nodes.groupBy(parent.alias("s")).agg(F.count("*").alias("degree"))
    leaves = nodes.join(degree, "s", "left_anti").select(F.col("s").alias("leaf"), F.col("depth").alias("leaf_depth"))
    above = leaves.select("leaf", "leaf_depth", F.explode(F.transform(F.sequence(F.lit(0), F.col("leaf_depth") - 1), lambda d: F.substring("leaf", F.lit(1), 2 * d))).alias("s"))
    forks = above.join(degree.filter("degree > 1 OR s = ''"), "s").groupBy("leaf", "leaf_depth").agg(F.max(F.length("s") / 2).cast("int").alias("fork"))
    arm = F.col("leaf_depth") - F.col("fork")
    return forks.agg(F.count("*").alias("arms"), F.sum(arm).alias("total"), F.max(arm).alias("longest"))


def common_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """The depth of the nearest common ancestor, in the trie of all items, of each item and the next."""
    items = short_texts(spark, folder).select("item_id", "b")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("b").alias("c")), "item_id")
    shorter = F.least(F.octet_length("b"), F.octet_length("c"))
    differ = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda p: F.substr("b", p, F.lit(1)) != F.substr("c", p, F.lit(1))))
    return pairs.select("item_id", F.when(shorter == 0, 0).otherwise(F.coalesce(differ - 1, shorter)).cast("long").alias("depth"))


def child_probe(spark: SparkSession, folder: str) -> DataFrame:
    """For every node on an item's path, the root included: is there a child by 'e'? How many nodes have one,
    the deepest of those children, and how many items are below them all together."""
    items = short_texts(spark, folder)
    asked = F.transform(F.sequence(F.lit(0), F.octet_length("b")), lambda d: F.concat(F.hex(F.substr(F.col("b"), F.lit(1), d)), F.lit("65")))
    hits = items.filter("b IS NOT NULL").select("item_id", F.explode(asked).alias("s")).join(_trie(spark, folder), "s")
    found = hits.groupBy("item_id").agg(F.count("*").alias("children"), F.max("depth").alias("deepest"), F.sum("freq").alias("below"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "deepest", "below")))


_GRAMS = """y AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) AS pos FROM documents),
g AS (SELECT h s1, h || lead(h, 1) OVER w s2, h || lead(h, 1) OVER w || lead(h, 2) OVER w s3, h || lead(h, 1) OVER w || lead(h, 2) OVER w || lead(h, 3) OVER w s4 FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
dict AS (""" + " UNION ALL ".join(f"(SELECT s{d} s, {d} depth, count(*) freq FROM g WHERE s{d} IS NOT NULL GROUP BY 1 ORDER BY freq DESC, s LIMIT 200)" for d in (1, 2, 3, 4)) + ")"
_SHORT = """b AS (SELECT item_id, hex(encode(text)) h FROM benchmark),
p AS (SELECT item_id, h, unnest(range(0, length(h) // 2)) AS pos FROM b)"""
_TRIE = """t AS (SELECT hex(encode(text)) h, unnest(range(1, octet_length(encode(text)) + 1)) d FROM benchmark),
n AS (SELECT substr(h, 1, 2 * d) s, d depth, count(*) freq FROM t GROUP BY 1, 2),
e AS (SELECT s, substr(s, 1, length(s) - 2) parent, ('0x' || substr(s, -2))::INTEGER AS label, depth::INTEGER AS depth, freq FROM n)"""
_PLACES = " UNION ALL ".join(f"SELECT user_id, {r} AS row, ((user_id % {SKETCH_PRIME}) * {sketch_factors(r)[0]} + {sketch_factors(r)[1]}) % {SKETCH_PRIME} % {CELLS} AS cell FROM events" for r in (0, 1))
_SKETCH = f"p AS ({_PLACES}), c AS (SELECT row, cell, count(*) n FROM p GROUP BY 1, 2)"


def _cell(row: int, width: int) -> str:
    a, b = sketch_factors(row)
    return f"((user_id % {SKETCH_PRIME}) * {a} + {b}) % {SKETCH_PRIME} % {width}"


_CONSERVATIVE = f"""WITH RECURSIVE e AS (SELECT event_id // {SLICE} AS stream, user_id, {_cell(0, FEW_CELLS)} + 1 AS p, {_cell(1, FEW_CELLS)} + {FEW_CELLS + 1} AS q, row_number() OVER (PARTITION BY event_id // {SLICE} ORDER BY event_id) r FROM events),
s(stream, r, l) AS (SELECT DISTINCT stream, 0::BIGINT, list_resize([]::BIGINT[], {2 * FEW_CELLS}, 0) FROM e UNION ALL
  SELECT s.stream, e.r, list_transform(l, lambda x, i: CASE WHEN i = p OR i = q THEN greatest(x, least(l[p], l[q]) + 1) ELSE x END) FROM s JOIN e ON e.stream = s.stream AND e.r = s.r + 1),
z AS (SELECT stream, max_by(l, r) l FROM s GROUP BY 1)
SELECT DISTINCT stream, user_id, least(l[p], l[q]) AS estimate FROM e JOIN z USING (stream)"""


def _one_counter(cap: int) -> str:
    """One counter, read event by event: item, count and threshold as the summary keeps them."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_type x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events),
s(user_id, r, item, f, t) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM events UNION ALL
  SELECT user_id, r, CASE WHEN same OR NOT free THEN item ELSE x END,
    CASE WHEN same THEN CASE WHEN m < {cap} THEN m + 1 ELSE f END WHEN free THEN t + 1 WHEN 2 * (t + 1) >= {cap} THEN (m - t - 1) // 2 ELSE f END,
    CASE WHEN same OR free THEN t WHEN 2 * (t + 1) >= {cap} THEN 0 ELSE t + 1 END
  FROM (SELECT s.user_id, e.r, s.item, s.f, s.t, e.x, greatest(s.f, s.t) m, coalesce(s.item = e.x, false) same, s.item IS NULL OR greatest(s.f, s.t) = s.t free FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
SELECT user_id, max_by(item, r) AS event_type, max_by(greatest(f, t) - t, r) AS n FROM s GROUP BY 1"""


ORACLE_SQL = {
    "mg_events": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "mg_users": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "mg_bound": "SELECT DISTINCT user_id, true AS within FROM events",
    "mg_one_counter": _one_counter(1 << 30),
    "mg_aged": _one_counter(4),
    "mg_merged_bound": "SELECT true AS within",
    "mg_merged_exact": "SELECT event_type, count(*) AS n, 0::BIGINT AS error FROM events GROUP BY 1",
    "builtin_topk": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC LIMIT 3",
    "topk_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "cm_upper": f"""WITH {_SKETCH}, t AS (SELECT user_id, count(*) t FROM events GROUP BY 1), q AS (SELECT DISTINCT * FROM p)
SELECT user_id, min(n) AS estimate, min(n) - any_value(t.t) AS above FROM q JOIN c USING (row, cell) JOIN t USING (user_id) GROUP BY 1""",
    "cm_cells": f"WITH {_SKETCH} SELECT row::INTEGER AS row, sum(n)::BIGINT AS total, max(n) AS largest, sum(n * n)::BIGINT AS squares, {CELLS} - count(*) AS zeros FROM c GROUP BY 1",
    "cm_conservative": _CONSERVATIVE,
    "population": "SELECT freq, count(*) AS items FROM (SELECT count(*) freq FROM events GROUP BY user_id) GROUP BY 1",
    "extract_min": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n, user_id LIMIT 1",
    "dictionary_probe": f"WITH {_GRAMS}, {_SHORT} SELECT item_id, pos, dict.s AS s, freq FROM p JOIN dict ON depth = 4 AND dict.s = substr(h, 2 * pos + 1, 8)",
    "longest_match": f"WITH {_GRAMS}, {_SHORT} SELECT item_id, pos, max(depth)::INTEGER AS depth FROM p JOIN dict ON starts_with(substr(h, 2 * pos + 1), dict.s) GROUP BY 1, 2",
    "suffix_links": f"WITH {_GRAMS} SELECT a.s, b.s AS link FROM dict a JOIN dict b ON b.s = substr(a.s, 3) WHERE a.depth > 1",
    "trie_edges": f"WITH {_TRIE} SELECT s, parent, label, depth, freq, row_number() OVER (PARTITION BY parent ORDER BY label) - 1 AS index FROM e",
    "trie_analysis": f"""WITH {_TRIE}, d AS (SELECT parent, count(*) degree FROM e GROUP BY 1)
SELECT count(*) AS nodes, count(*) FILTER (k.degree IS NULL) AS leaves, max(k.degree) AS max_degree, sum(coalesce(k.degree, 0))::BIGINT AS inner_degree, count(*) FILTER (k.degree IS NULL AND q.degree = 1) AS arms
FROM e LEFT JOIN d k ON k.parent = e.s JOIN d q ON q.parent = e.parent""",
    "trie_arms": f"""WITH {_TRIE}, d AS (SELECT parent s, count(*) degree FROM e GROUP BY 1), l AS (SELECT s FROM e WHERE s NOT IN (SELECT s FROM d)),
k AS (SELECT l.s, max(length(d.s)) // 2 fork FROM l JOIN d ON starts_with(l.s, d.s) AND length(d.s) % 2 = 0 WHERE degree > 1 OR d.s = '' GROUP BY 1)
SELECT count(*) AS arms, sum(length(s) // 2 - fork)::BIGINT AS total, max(length(s) // 2 - fork)::INTEGER AS longest FROM k""",
    "common_ancestors": """WITH h AS (SELECT item_id, hex(encode(text)) h FROM benchmark), p AS (SELECT a.item_id, a.h x, b.h y FROM h a JOIN h b ON b.item_id = a.item_id + 1)
SELECT item_id, coalesce(list_max(list_filter(range(0, least(length(x), length(y)) // 2 + 1), lambda k: substr(x, 1, 2 * k) = substr(y, 1, 2 * k))), 0)::BIGINT AS depth FROM p""",
    "child_probe": f"""WITH {_TRIE}, a AS (SELECT item_id, substr(hex(encode(text)), 1, 2 * unnest(range(0, octet_length(encode(text)) + 1))) || '65' s FROM benchmark),
k AS (SELECT item_id, count(*) children, max(depth) deepest, sum(freq)::BIGINT below FROM a JOIN n USING (s) GROUP BY 1)
SELECT item_id, coalesce(children, 0) AS children, coalesce(deepest, 0)::INTEGER AS deepest, coalesce(below, 0) AS below FROM benchmark LEFT JOIN k USING (item_id)""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
