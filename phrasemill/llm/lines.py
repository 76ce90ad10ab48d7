"""Line dedup: exact copies of lines, and lines within a small edit distance, across all documents.

Lines are near if at most THRESHOLD edits, and at most one for each PER characters of the longer, part them (a
similarity of 0.8 or more). The join is by segments: a line of l characters is cut into threshold-plus-one
segments, one of which any line within the threshold holds unchanged, at a place that the two lengths allow. A
line is entered under its own segments (it owns those keys) and probes, for every length from its own down to
the threshold less, the substrings at those places. Keys (hashes of length, segment number and content) are
dealt to buckets, compressed, and sorted there; only keys that different lines share go on. Their lines' texts
are fetched and each key's owners verified against its lines by a banded bit-parallel edit distance, which
returns a spanning forest of the links of a group.

A key that more than HOT lines share is split, again and again: within it the shared segment is without errors,
so what all rests of the lines have in common at both ends is stripped, the rest is cut into segments, and the
lines are dealt out by those, until a group is small or the rest is too short to be cut. A key that is hot
within one task's batch is not sorted in its bucket at all; its lines are dealt out by themselves.

The first line (by doc_id, then line number) of each class of linked lines stays, the others go. The text of
a line that is repeated is sent once for each task's batch of documents, not for each copy.

Defined results: a null text has no lines; lines without a word stay; lines of fewer than PER - 1 characters are
compared exactly only (no edit leaves them similar enough); very long texts and lines are taken whole; a row
without doc_id is left as it is and is no reason to remove anything; rows that repeat a doc_id are the same
document (line numbers decide, and equal rows are cut alike); an empty table gives an empty result. Other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.blobs import DEALT, arrow_rows, batch, dealt, free_name, multikey_order, open_text, pack, parts, squeeze, together, trimmed, unpack_all
from phrasemill.llm.components import connected
from phrasemill.llm.skew import hot_join
from phrasemill.session import few, stored, table

THRESHOLD, PER = 2, 5
BUCKET_BYTES = 4 << 20  # text whose keys make a bucket, about
TASK_BUCKETS = 4  # buckets of a task, about
BATCH_BYTES = 4 << 20  # text that a task takes at a time
ROWS = 1024  # documents in an Arrow batch
HOT = 250  # lines that share a key beyond which they are dealt out by the rest of the line
_MASK = (1 << 64) - 1


def allowed(length: int) -> int:
    """Edits that may part a line of this length from one that is no longer."""
    return min(THRESHOLD, length // PER)


def segments(length: int, count: int = THRESHOLD + 1) -> list[tuple[int, int]]:
    """[start, end) of the segments of a line of this length."""
    return [(length * i // count, length * (i + 1) // count) for i in range(count)]


def probes(length: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int, bool]]:
    """(length of the other line, segment, start, end, whether it is the line's own segment): what a line
    of this length enters and looks up. The places follow from both ends: the i-th segment has at most i
    errors before it and threshold - i after it, or an earlier or later segment would match."""
    out = []
    for shorter in range(threshold + 1):
        other = length - shorter
        if other <= threshold:
            break
        for i, (start, end) in enumerate(segments(other, threshold + 1)):
            low = max(start - i, start + shorter - (threshold - i), 0)
            high = min(start + i, start + shorter + (threshold - i), length - (end - start))
            out += [(other, i, at, at + end - start, shorter == 0 and at == start) for at in range(low, high + 1)]
    return out


_known: dict[tuple[int, bool], list[tuple[int, int, int, bool]]] = {}


def _places(length: int, whole: bool) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, own) of a line of this length, or of a rest of a line. A whole line looks up the
    segments for the edits that it may have as the longer one, and owns those for the edits that a longer
    one may have."""
    if (length, whole) not in _known:
        if len(_known) > 20_000:
            _known.clear()
        out = []
        for t in range(1, THRESHOLD + 1):
            if not whole:
                out += [(other << 4 | i, a, b, own) for other, i, a, b, own in probes(length, t) if t == THRESHOLD]
            elif t == allowed(length):
                out += [(other << 4 | t << 2 | i, a, b, own) for other, i, a, b, own in probes(length, t)]
            elif any(allowed(longer) == t for longer in range(length, length + t + 1)):
                out += [(length << 4 | t << 2 | i, a, b, True) for i, (a, b) in enumerate(segments(length, t + 1))]
        _known[length, whole] = out
    return _known[length, whole]


def _keys(line: str) -> list[tuple[int, bool, int, int]]:
    """(key of 39 bits, own, start, end) of every probe of a line."""
    hashed = xxhash.xxh3_64_intdigest
    return [(hashed(line[a:b].encode(), seed) >> 25, own, a, b) for seed, a, b, own in _places(len(line), True)]


def _inner(key: int, rest: str) -> list[tuple[int, bool, str | None]]:
    """(key within the key, own, rest of the rest) of the rest of a line. Rests of two characters or less have
    no segments: they meet what is up to two characters longer under a last key."""
    hashed = xxhash.xxh3_64_intdigest
    out = dict.fromkeys((hashed(rest[a:b].encode(), (key * 0x9E3779B97F4A7C15 + seed) & _MASK), own, rest[:a] + rest[b:]) for seed, a, b, own in _places(len(rest), False))
    if len(rest) <= 2 * THRESHOLD:
        out[hashed(b"", (key * 0x9E3779B97F4A7C15 + 15) & _MASK), len(rest) <= THRESHOLD, None] = None
    return list(out)


def within(a: str, b: str, threshold: int = THRESHOLD) -> bool:
    """Whether the edit distance is at most the threshold. After common ends are taken off, one bit row for
    each number of errors holds which of the 2 * threshold + 1 diagonals are reachable."""
    if abs(len(a) - len(b)) > threshold:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << (i + threshold)  # bit d of (places >> j) tells whether a[j - threshold + d] is c
    width = (1 << (2 * threshold + 1)) - 1
    # Row k, bit d: after j characters of b, j - threshold + d characters of a are matched with k errors.
    rows = [((1 << (k + 1)) - 1) << threshold for k in range(threshold + 1)]
    for j, c in enumerate(b):
        equal = (places.get(c, 0) >> j) & width
        before, out = rows, []
        for k in range(threshold + 1):
            row = before[k] & equal
            if k:
                row |= before[k - 1] | (before[k - 1] >> 1) | (out[k - 1] << 1)
            out.append(row & width)
        rows = out
        if not rows[threshold]:
            return False
    at = len(a) - len(b) + threshold
    return bool((rows[threshold] >> at) & 1)


def near(a: str, b: str) -> bool:
    """Whether two lines are similar enough."""
    return within(a, b, allowed(max(len(a), len(b))))


def _halves(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(line.encode())
    return digest >> 64, digest & 0xFFFFFFFFFFFFFFFF


def _signed(x: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = [
                (doc, number, *_halves(line))
                for doc, text in zip(batch.column(0).slice(at, 1024).to_pylist(), batch.column(1).slice(at, 1024).to_pylist(), strict=True)
                for number, line in enumerate(text.split("\n"))
                if line.strip()
            ]
            doc, number, high, low = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), _signed(high), _signed(low)], ["doc_id", "line", "high", "low"])


KEYS, HOT_LINES, HOT_KEYS = 0, 1, 2  # keys and lines; those of keys hot in one batch; such keys


def _deal_keys(buckets: int, hot: int):
    each = together(buckets)

    def flush(lines: set[str]) -> pa.RecordBatch:
        key, who, size = array("Q"), array("Q"), array("L")
        for line in lines:
            found = [k << 1 | mine for k, mine, _, _ in _keys(line)]
            key.extend(found)
            who.append(_halves(line)[0] >> 16)
            size.append(len(found))
        keys, ids = np.array(key, np.uint64), np.repeat(np.array(who, np.uint64), np.array(size, np.int64))
        del key
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        plain = keys >> np.uint64(1)
        firsts = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]])) if len(plain) else np.zeros(0, np.int64)
        many = np.diff(np.append(firsts, len(plain)))
        last = firsts + many - 1  # keys that are owned sort last
        crowded = (many > 2 * hot) & (keys[last] & np.uint64(1) > 0)  # a line may hold a key at two places
        rows = []
        if crowded.any():
            marks, apart = keys[last[crowded]], np.repeat(crowded, many)
            rows += [(b, HOT_KEYS, pack(marks[at])) for b, at in parts(((marks >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64) // each)]
            key, who = keys[apart], ids[apart]
            rows += [(b, HOT_LINES, pack(key[at], who[at])) for b, at in parts((who % np.uint64(buckets)).astype(np.int64) // each)]
            keys, ids, plain = keys[~apart], ids[~apart], plain[~apart]
        return batch(rows + [(b, KEYS, pack(keys[at], ids[at])) for b, at in parts((plain % np.uint64(buckets)).astype(np.int64) // each)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: set[str] = set()
        size = 0
        for one in batches:
            for text in one.column(0):
                for line in text.as_py().split("\n"):
                    if len(line) >= PER - 1 and line not in lines and line.strip():
                        lines.add(line)
                        size += len(line) + 100
                    if size >= BATCH_BYTES:
                        yield flush(lines)
                        lines, size = set(), 0
        if lines:
            yield flush(lines)

    return deal


def _deal_keys_again(buckets: int):
    def again(columns: int, by: int):
        def deal(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
            own = unpack_all(blobs, columns)
            for bucket, at in parts(((own[by] >> np.uint64(1 - by)) % np.uint64(buckets)).astype(np.int64)):
                yield bucket, pack(*(c[at] for c in own))

        return deal

    return {KEYS: again(2, 0), HOT_LINES: again(2, 1), HOT_KEYS: again(1, 0)}


def _shared_keys(hot: int):
    def shared(group: pa.Table) -> pa.Table:
        """Keys that different lines hold, one of them as its own segment: key, line, how many lines, own."""
        blobs: dict[int, list[bytes]] = {KEYS: [], HOT_LINES: [], HOT_KEYS: []}
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
            blobs[kind].append(blob)
        key, who = unpack_all(blobs[KEYS], 2)
        marks = unpack_all(blobs[HOT_KEYS], 1)[0] >> np.uint64(1)
        plain = key >> np.uint64(1)
        order, new = multikey_order(plain, who)
        kept, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(key):
            at = np.cumsum(new[0]) - 1
            firsts = np.flatnonzero(new[0])
            crowded = np.isin(plain[order[firsts]], marks)
            lines = np.where(crowded, hot + 1, np.add.reduceat(new[1].astype(np.int64), firsts))
            owned = crowded | (np.maximum.reduceat(key[order] & np.uint64(1), firsts) > 0)
            kept = np.flatnonzero(((lines > 1) & owned)[at])
            many = lines[at[kept]]
        key, who = key[order[kept]], who[order[kept]]
        more = unpack_all(blobs[HOT_LINES], 2)
        key, who, many = np.concatenate([key, more[0]]), np.concatenate([who, more[1]]), np.concatenate([many, np.full(len(more[0]), hot + 1)])
        return pa.table({"key": _signed(key >> np.uint64(1)), "short": _signed(who), "many": pa.array(many.astype(np.int64)), "own": pa.array((key & np.uint64(1)).astype(bool))})

    return shared


_LINE = "doc_id long, line int, text string"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of a document."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("many", pa.int64()), ("own", pa.bool_())]))
    for one in batches:
        rows: list[tuple] = []
        for doc, packed, wanted in zip(one.column(0).to_pylist(), one.column(1), one.column(2).to_pylist(), strict=True):
            lines, keys = open_text(packed).decode().split("\n"), defaultdict(list)
            for w in wanted:
                keys[w["line"]].append({"key": w["key"], "many": w["many"], "own": w["own"]})
            rows += [(doc, number, lines[number], own) for number, own in keys.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), kind), strict=True)], ["doc_id", "line", "text", "keys"])


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines with a hot key, what is left without its segment."""
    for one in batches:
        rows = []
        for doc, number, line, hot in zip(*(one.column(i).to_pylist() for i in range(4)), strict=True):
            for rest in {line[:a] + line[b:] for key, _, a, b in _keys(line) if key == hot}:
                rows.append((hot, doc, number, line, rest))
        yield _leveled(rows)


_LEVEL = f"key long, {_LINE}, rest string"


def _leveled(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["key", "doc_id", "line", "text", "rest"])


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rests dealt out by their segments, without what all rests of a key have in common at their ends."""
    for one in batches:
        rows, owned = [], []
        for key, doc, number, line, rest, first, last, back, front, least in zip(*(one.column(i).to_pylist() for i in range(10)), strict=True):
            before = min(_common(first, last), least)
            after = min(_common(back, front), least - before)
            for inner, own, left in _inner(key, rest[before : len(rest) - after]):
                rows.append((inner - (1 << 64) if inner >> 63 else inner, doc, number, line, left))
                owned.append(own)
        out = _leveled(rows)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(owned, pa.bool_())], [*out.schema.names, "own"])


def group_links(texts: list[str], own: list[bool]) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group between owners and lines that are no shorter. Pairs that
    are in one tree already are left out in blocks, and so are those whose letters differ too much in number."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    counts = np.zeros((len(texts), 64), np.int16)
    for row, i in enumerate(order):
        for c, n in Counter(texts[i]).items():
            counts[row, ord(c) % 64] += min(n, 10_000)
    lens = np.array([len(texts[i]) for i in order])
    tree, links = np.arange(len(texts)), []
    for row in range(len(order)):
        if not own[order[row]]:
            continue
        start, stop = np.searchsorted(lens, lens[row], side="left"), np.searchsorted(lens, lens[row] + THRESHOLD, side="right")
        for at in range(int(start), int(stop), 1 << 14):
            apart = at + np.flatnonzero(tree[at : min(int(stop), at + (1 << 14))] != tree[row])
            close = apart[np.abs(counts[apart] - counts[row]).sum(axis=1) <= 2 * THRESHOLD]
            for other in close.tolist():
                if tree[other] != tree[row] and near(texts[order[row]], texts[order[other]]):
                    links.append((order[row], order[other]))
                    tree[tree == tree[other]] = tree[row]
    return links


def _verify(group: pa.Table) -> pa.Table:
    members: dict[int, dict[tuple[int, int, str], bool]] = defaultdict(dict)
    for key, doc, number, text, own in zip(*(group.column(c).to_pylist() for c in ("key", "doc_id", "line", "text", "own")), strict=True):
        members[key][doc, number, text] = own or members[key].get((doc, number, text), False)
    links = set()
    for group_ in members.values():
        lines = list(group_)
        links |= {(lines[i][:2], lines[j][:2]) for i, j in group_links([t for _, _, t in lines], list(group_.values()))}
    ends = [[{"doc_id": p[e][0], "line": p[e][1]} for p in links] for e in (0, 1)]
    kind = pa.struct([("doc_id", pa.int64()), ("line", pa.int32())])
    return pa.table({"u": pa.array(ends[0], kind), "v": pa.array(ends[1], kind)})


_PLACE = "struct<doc_id:bigint,line:int>"


def _small_groups(rows: DataFrame, hot: int) -> list[DataFrame]:
    """rows (key, doc_id, line, text, rest) of hot keys, split until their groups are small or cannot be
    split: key, doc_id, line, text, own."""
    out = []
    while True:
        back = F.reverse("rest")
        ends = rows.groupBy("key").agg(F.min("rest").alias("first"), F.max("rest").alias("last"), F.min(back).alias("back"), F.max(back).alias("front"), F.min(F.length("rest")).alias("least"))
        inner = stored(rows.join(ends, "key").select(*rows.columns, "first", "last", "back", "front", "least").mapInArrow(_split, f"{_LEVEL}, own boolean"))
        counts = inner.groupBy("key").agg(F.count("*").alias("many"), F.max("own").alias("owned"))
        crowded = stored(few(counts.filter(F.col("many") > hot), inner.count() // hot))
        if not crowded.count():
            return [*out, inner.drop("rest")]
        out.append(inner.join(crowded, "key", "left_anti").drop("rest"))
        again = inner.join(crowded.filter("owned"), "key", "left_semi")
        out.append(again.filter("rest IS NULL").drop("rest"))
        rows = again.filter("rest IS NOT NULL").drop("own")


def line_classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, line, first (the place of the first line of its class) and near (whether that line differs)
    of every line that has another in its class."""
    spark = docs.sparkSession
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, ROWS):
        lines = stored(texts.mapInArrow(trimmed(_list_lines), "doc_id long, line int, high long, low long"))
    firsts = stored(few(lines.groupBy("high", "low").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("copies")), lines.count()))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_BYTES))
    tasks = -(-buckets // TASK_BUCKETS)
    keys = dealt(texts.select("text").mapInArrow(trimmed(_deal_keys(buckets, hot)), DEALT), buckets, _deal_keys_again(buckets))
    shared = keys.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_shared_keys(hot), "key long, short long, many long, own boolean")
    wanted = shared.join(firsts.withColumn("short", F.shiftrightunsigned("high", 16)), "short").select("first.doc_id", F.struct(F.col("first.line").alias("line"), "key", "many", "own").alias("w"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    packed = texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(squeeze, "doc_id long, packed binary")
    with arrow_rows(spark, ROWS):
        fetched = stored(packed.join(by_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "packed", "wanted").mapInArrow(trimmed(_fetch), f"{_LINE}, keys array<struct<key:bigint,many:bigint,own:boolean>>"))
    by_key = fetched.select("doc_id", "line", "text", F.explode("keys").alias("k")).select("k.key", "doc_id", "line", "text", "k.own", "k.many")
    groups = [by_key.filter(F.col("many") <= hot).drop("many")]
    crowded = by_key.filter(F.col("many") > hot)
    if crowded.limit(1).count():
        groups += _small_groups(stored(crowded.select("doc_id", "line", "text", "key").distinct().mapInArrow(_rests, _LEVEL)), hot)
    rows = reduce(DataFrame.unionByName, groups)
    links = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(4 * buckets))).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_verify, f"u {_PLACE}, v {_PLACE}")
    with arrow_rows(spark, ROWS):
        roots = connected(links).withColumnRenamed("node", "first")
    classes = firsts.join(roots, "first", "left").select("high", "low", "copies", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "first").alias("first"), F.coalesce(F.col("root") != F.col("first"), F.lit(False)).alias("near"))
    shared_classes = classes.filter("copies > 1 OR linked").select("high", "low", "copies", "first", "near")
    return hot_join(lines, shared_classes, ["high", "low"], "copies").select("doc_id", "line", "first", "near")


def _by_document(classes: DataFrame) -> DataFrame:
    gone = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.line") != F.col("line"))
    one = F.struct("line", F.col("first.doc_id").alias("first"), "near")
    return classes.filter(gone).groupBy("doc_id").agg(F.collect_list(one).alias("gone"))


def _kept(text: str, gone: list[dict] | None) -> str:
    if not gone:
        return text
    out = {g["line"] for g in gone}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, packed, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = open_text(packed).decode()
            kept = _kept(text, gone)
            seen = list({g["line"]: g for g in gone or []}.values())
            lines = sum(1 for line in text.split("\n") if line.strip())
            rows.append((doc, lines, len(seen), sum(g["near"] for g in seen), sorted({g["first"] for g in seen}), len(kept), hashlib.sha256(kept.encode()).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_lines", "n_removed", "n_near", "first_docs", "kept_chars", "kept_sha256"])


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For every row of docs: doc_id, lines with a word, how many of them go (and how many of those are not
    exact copies), the documents that hold the lines which stay for them, and the kept text's size and hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    packed = texts.mapInArrow(squeeze, "doc_id long, packed binary")
    joined = packed.join(_by_document(line_classes(docs, hot)).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "packed", "gone")
    return joined.mapInArrow(_digest, "doc_id long, n_lines long, n_removed long, n_near long, first_docs array<long>, kept_chars long, kept_sha256 string")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column says which lines go."""
    for batch in batches:
        at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
        old, found = batch.column(at).to_pylist(), batch.column(last).to_pylist()
        new = [_kept(t, g) if t else t for t, g in zip(old, found, strict=True)]
        stay = pa.array([not g or bool(n and n.strip()) for n, g in zip(new, found, strict=True)])
        yield batch.set_column(at, "text", pa.array(new, pa.string())).select(range(last)).filter(stay)


def drop_repeated_lines(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs without the lines that go (n_chars, if there is one, set anew); a document of which no line with
    a word is left goes, one that had none stays."""
    doc, gone = free_name("__doc", docs.columns), free_name("__gone", docs.columns)
    found = _by_document(line_classes(docs, hot)).withColumnsRenamed({"doc_id": doc, "gone": gone})
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found[doc], "left").drop(doc)
    cut = joined.mapInArrow(trimmed(_clean), docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
