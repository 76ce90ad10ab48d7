"""Exact substring dedup over a sparse suffix array.

Suffixes are sampled where content says so: of the K-byte tokens in an L-byte string, the one with the
least hash (leftmost of equals) owns the string, so two equal strings have equal owners at equal places.
A suffix record is its leading token (the owner's hash), its second token (a hash of the whole span of
strings that the owner owns) and its place. Sampled splitters range-partition the records by leading
token; a bucket sorts by multikey quicksort (ties only go on to the next token).

- Records of equal tokens have equal spans: all but the smallest doc_id lose theirs.
- Where a leading token continues differently, the spans' bytes themselves are dealt out again by the
  leading token, and all their L-byte strings sorted by multikey quicksort on eight-byte words.
- No run of equals is cut by a splitter (splitters are compared with leading tokens only). A leading
  token with very many continuations (the edge of a passage that many documents hold) would make a
  bucket of unbounded size, so its strings are dealt out by their own 128-bit hashes instead.

Every task first resolves what repeats within its own rows and sends only the smallest doc_id of each
span, so a passage that a third of all documents hold costs its bucket one record per task.

Leading tokens are compared by 40-bit hashes, not by their text: their order is only for dealing them out, and a
false tie costs time, never a wrong result, as what ties is compared further, in the end by all its bytes. So no
run of equals reaches over a boundary, and nothing needs to be compared across one.

Defined results: a null text is empty; a text of fewer than L bytes loses nothing; a very long text is searched
whole, a piece at a time; a row without doc_id is neither searched nor cut; rows that repeat a doc_id are the same
document (they are cut alike, and never by each other); an empty table gives an empty result. Other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.blobs import DEALT, arrow_rows, batch, dealt, free_name, multikey_order, open_text, pack, parts, press, squeeze, together, trimmed, unpack, unpack_all, unpress
from phrasemill.session import stored, table

LENGTH, TOKEN = 50, 20
BATCH_BYTES = 4 << 20  # text that a task takes into memory at a time
ROWS = 1024  # documents in an Arrow batch
PIECE = 1 << 19  # bytes hashed at a time
BUCKET_BYTES = 4 << 20  # text whose records make a bucket, about
TASK_BUCKETS = 4  # buckets of a task, about
SAMPLE_DOCS, SAMPLE_TOKENS = 2000, 32  # the splitters' sample: about so many documents, so many leading tokens of each at most
HOT = 4096  # continuations of a leading token beyond which its strings are dealt out by their own hashes
_BASE = 0x9E3779B97F4A7C15
_LEAD = np.uint64(24)  # a leading token keeps 40 bits: a false tie costs time, never a wrong result


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def token_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash of every ``size`` bytes, by doubling."""
    part, width, done, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = size
    while left:
        if left & 1:
            if done is None:
                done, have = part, width
            else:
                n = len(data) - have - width + 1
                done, have = done[:n] * _power(width) + part[have : have + n], have + width
        left >>= 1
        if left:
            n = len(part) - width
            part, width = part[:n] * _power(width) + part[width : width + n], width * 2
    done = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    part, n = values, 1
    while n * 2 <= width:
        part, n = np.minimum(part[:-n], part[n:]), n * 2
    count = len(values) - width + 1
    return part[:count] if n == width else np.minimum(part[:count], part[width - n : width - n + count])


def spans(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, leading token) of the span of each run of strings with one owner. data: documents
    one after the other; ends: where each ends. No string crosses documents. Long input goes in pieces;
    a run that a piece's end cuts is two spans, whose strings still meet in the second step."""
    lens = np.diff(ends, prepend=0)
    ok = lens >= length
    change = np.zeros(len(data) + 1, np.int8)
    change[(ends - lens)[ok]] += 1
    np.add.at(change, ends[ok] - length + 1, -1)
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    begins = np.zeros(len(data) + 1, bool)
    begins[(ends - lens)[ok]] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        hashes = token_hashes(data[at : at + PIECE + length - 1], token)
        places = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        owner = _sliding_min(places, length - token + 1).astype(np.uint32)
        own = valid[at : at + len(owner)]
        new = own.copy()
        new[1:] &= (owner[1:] != owner[:-1]) | ~own[:-1] | begins[at + 1 : at + len(owner)]
        last = own.copy()
        last[:-1] &= new[1:] | ~own[1:]
        start, end = np.flatnonzero(new), np.flatnonzero(last)
        out.append((start + at, end + at + length, hashes[owner[start]] >> _LEAD))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _later(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (unordered) whose doc_id is above the least in their run of equals."""
    if not len(order):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = doc[order] > least
    return later


FOUND, OPEN, HOT_OPEN = 0, 1, 2  # a span to remove; one to compare by its bytes; one with a hot leading token
_ROWS = "kind int, doc_id long, span long, lead long"  # span: start << 8 | length


def _cut(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(8)) | (end - start).astype(np.uint64)


def splitters(sample: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets end: quantiles of the sorted sample, in between them as many as are wanted."""
    if not len(sample) or buckets < 2:
        return np.zeros(0, np.uint64)
    at = np.arange(1, buckets) * (len(sample) - 1) / buckets
    low, part = sample[at.astype(np.int64)], at - at.astype(np.int64)
    high = sample[np.minimum(at.astype(np.int64) + 1, len(sample) - 1)]
    return low + ((high - low) * part).astype(np.uint64)


def _deal_by_token(sample: np.ndarray, buckets: int):
    groups = splitters(sample, buckets)[together(buckets) - 1 :: together(buckets)]

    def flush(ids: list[int], texts: list[bytes], number: int) -> pa.RecordBatch:
        buffer = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        start, end, lead = spans(np.frombuffer(buffer, np.uint8), ends)
        view = memoryview(buffer)
        whole = np.empty(len(start), np.uint64)
        for i in range(0, len(start), 1 << 14):
            part = slice(i, i + (1 << 14))
            whole[part] = np.fromiter(map(xxhash.xxh3_64_intdigest, map(view.__getitem__, map(slice, start[part].tolist(), end[part].tolist()))), np.uint64)
        at = np.searchsorted(ends, start, side="right")
        doc = np.array(ids, np.int64)[at] if len(ids) else np.zeros(0, np.int64)
        span = _cut(start - np.concatenate([[0], ends[:-1]])[at], end - np.concatenate([[0], ends[:-1]])[at])
        order, new = multikey_order(whole, lead)
        later = _later(order, new[-1], doc)
        rows = [(number % (len(groups) + 1), FOUND, pack(doc[later], span[later]))] if later.any() else []
        send = np.flatnonzero(~later)
        for bucket, at in parts(np.searchsorted(groups, lead[send], side="left")):
            part = send[at]
            rows.append((bucket, OPEN, pack(lead[part], whole[part], doc[part], span[part])))
        return batch(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield flush(ids, texts, number)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield flush(ids, texts, number)

    return deal


def _deal_by_token_again(sample: np.ndarray, buckets: int):
    def again(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        columns = unpack_all(blobs, 4)
        for bucket, at in parts(np.searchsorted(splitters(sample, buckets), columns[0], side="left")):
            yield bucket, pack(*(c[at] for c in columns))

    return {OPEN: again}


def _rows(kind: np.ndarray, doc: np.ndarray, span: np.ndarray, lead: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(kind.astype(np.int32)), "doc_id": pa.array(doc.astype(np.int64)), "span": pa.array(span.astype(np.int64)), "lead": pa.array(lead.astype(np.int64))})


def _split_blobs(group: pa.Table) -> dict[int, list[bytes]]:
    blobs: dict[int, list[bytes]] = {FOUND: [], OPEN: [], HOT_OPEN: []}
    for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
        blobs[kind].append(blob)
    return blobs


def _sort_bucket(most: int):
    """most: continuations of a leading token beyond which it is hot."""

    def sort(group: pa.Table) -> pa.Table:
        """Equal spans: all but the smallest doc_id are found. Leading tokens that go on differently stay open."""
        blobs = _split_blobs(group)
        done_doc, done_span = unpack_all(blobs[FOUND], 2)
        lead, whole, doc, span = unpack_all(blobs[OPEN], 4)
        doc = doc.view(np.int64)
        order, new = multikey_order(lead, whole)
        later = _later(order, new[1], doc)
        kind = np.zeros(len(lead), np.int32)
        if len(lead):
            group_of = np.cumsum(new[0]) - 1
            firsts = np.flatnonzero(new[0])
            sorted_doc = doc[order]
            differ = np.minimum.reduceat(sorted_doc, firsts) != np.maximum.reduceat(sorted_doc, firsts)
            goes_on = np.add.reduceat(new[1].astype(np.int64), firsts)
            wanted = ~later[order] & (differ & (goes_on > 1))[group_of]
            hot = np.bincount(group_of[wanted], minlength=len(firsts)) > most
            kind[order] = np.where(wanted, np.where(hot[group_of], HOT_OPEN, OPEN), FOUND)
        keep = later | (kind > 0)
        none = np.zeros(len(done_doc), np.uint64)
        return _rows(np.concatenate([none, kind[keep]]), np.concatenate([done_doc.view(np.int64), doc[keep]]), np.concatenate([done_span, span[keep]]), np.concatenate([none, lead[keep]]))

    return sort


def _texts(doc: list[int], span: list[int], lead: list[int], texts: list[bytes]) -> bytes:
    """Spans and their bytes as one blob."""
    numbers = pack(np.array(doc, np.int64), np.array(span, np.uint64), np.array(lead, np.uint64))
    return len(numbers).to_bytes(8, "little") + numbers + press(b"".join(texts))


def _open_texts(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    """(doc_id, span and lead) and the bytes one after the other."""
    n = int.from_bytes(blob[:8], "little")
    return unpack(blob[8 : 8 + n], 3), unpress(blob[8 + n :])


def _deal_open_again(sample: np.ndarray, buckets: int):
    def spans_again(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        numbers, texts = zip(*map(_open_texts, blobs), strict=True)
        doc, span, lead = (np.concatenate(x) for x in zip(*numbers, strict=True))
        text, ends = b"".join(texts), np.cumsum(span & np.uint64(255)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for bucket, at in parts(np.searchsorted(splitters(sample, buckets), lead, side="left")):
            yield bucket, _texts(doc[at], span[at], lead[at], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

    def strings_again(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        columns = unpack_all(blobs, 4)
        for bucket, at in parts((columns[0] % np.uint64(buckets)).astype(np.int64)):
            yield bucket, pack(*(c[at] for c in columns))

    return {OPEN: spans_again, HOT_OPEN: strings_again}


def _deal_open(sample: np.ndarray, buckets: int):
    each = together(buckets)
    groups = splitters(sample, buckets)[each - 1 :: each]

    def flush(entries: list[tuple], number: int) -> pa.RecordBatch:
        rows = []
        cold = [e for e in entries if e[0] == OPEN]
        for bucket, at in parts(np.searchsorted(groups, np.array([e[3] for e in cold], np.uint64), side="left")):
            _, doc, span, lead, texts = zip(*(cold[i] for i in at.tolist()), strict=True)
            rows.append((bucket, OPEN, _texts(doc, span, lead, texts)))
        hot = [(e[1], (e[2] >> 8) + i, e[4][i : i + LENGTH]) for e in entries if e[0] == HOT_OPEN for i in range((e[2] & 255) - LENGTH + 1)]
        if hot:
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(x[2]), 1 << 64) for x in hot], np.uint64)
            doc, span = np.array([x[0] for x in hot], np.int64), np.array([x[1] << 8 | LENGTH for x in hot], np.uint64)
            order, new = multikey_order(digests[:, 0], digests[:, 1])
            later = _later(order, new[1], doc)
            if later.any():
                rows.append((number % (len(groups) + 1), FOUND, pack(doc[later], span[later])))
            send = np.flatnonzero(~later)
            for bucket, at in parts((digests[send, 0] % np.uint64(buckets)).astype(np.int64) // each):
                part = send[at]
                rows.append((bucket, HOT_OPEN, pack(digests[part, 0], digests[part, 1], doc[part], span[part])))
        return batch(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, size, number = [], 0, 0
        for batch in batches:
            for doc, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = open_text(packed)
                for e in found:
                    start, n = e["span"] >> 8, e["span"] & 255
                    entries.append((e["kind"], doc, e["span"], e["lead"], text[start : start + n]))
                size += sum(600 if e["kind"] == OPEN else 600 * (e["span"] & 255) for e in found)
                if size >= 8 * BATCH_BYTES:
                    yield flush(entries, number)
                    entries, size, number = [], 0, number + 1
        if entries:
            yield flush(entries, number)

    return deal


def _runs(covered: np.ndarray, owner: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the runs of covered strings; owner, doc and at (place in its document) are of each string."""
    i = np.flatnonzero(covered)
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cut = np.flatnonzero((np.diff(i) > 1) | (owner[i[1:]] != owner[i[:-1]]))
    first, last = i[np.concatenate([[0], cut + 1])], i[np.concatenate([cut, [len(i) - 1]])]
    return doc[first], _cut(at[first], at[last] + LENGTH)


def _sort_strings(group: pa.Table) -> pa.Table:
    """All L-byte strings of a bucket's spans, by multikey quicksort on their eight-byte words."""
    blobs = _split_blobs(group)
    docs, cuts = unpack_all(blobs[FOUND], 2)
    out = [(docs.view(np.int64), cuts)]
    high, low, doc, span = unpack_all(blobs[HOT_OPEN], 4)
    order, new = multikey_order(high, low)
    later = _later(order, new[1], doc.view(np.int64))
    out.append((doc.view(np.int64)[later], span[later]))
    if blobs[OPEN]:
        numbers, texts = zip(*map(_open_texts, blobs[OPEN]), strict=True)
        doc, span, _ = (np.concatenate(x) for x in zip(*numbers, strict=True))
        buffer = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        size = (span & np.uint64(255)).astype(np.int64)
        count = size - LENGTH + 1
        owner = np.repeat(np.arange(len(span)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = (np.cumsum(size) - size)[owner] + step
        words = np.lib.stride_tricks.as_strided(buffer.view(), (len(buffer) - 7, 8), (1, 1))
        keys = [np.ascontiguousarray(words[place + i]).view(">u8").reshape(-1).astype(np.uint64) for i in (*range(0, LENGTH - 8, 8), LENGTH - 8)]
        doc = doc.view(np.int64)[owner]
        order, new = multikey_order(*keys)
        out.append(_runs(_later(order, new[-1], doc), owner, doc, (span >> np.uint64(8)).astype(np.int64)[owner] + step))
    doc, span = (np.concatenate(x) for x in zip(*out, strict=True))
    zero = np.zeros(len(doc), np.int64)
    return _rows(zero, doc, span, zero)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            lead = spans(data, np.array([len(data)], np.int64))[2]
            yield pa.RecordBatch.from_arrays([pa.array(lead[:: -(-len(lead) // SAMPLE_TOKENS)].astype(np.int64))], ["lead"])


def _sampled(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Leading tokens of a bounded sample of documents, sorted; and how many buckets there are to be."""
    total, count = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // BUCKET_BYTES))
    picked = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SAMPLE_DOCS))) == 0).select("text")
    rows = picked.mapInArrow(_sample, "lead long").limit(4 * SAMPLE_DOCS * SAMPLE_TOKENS).collect()
    return np.sort(np.array([r.lead for r in rows], np.int64).view(np.uint64)), buckets


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, span (start << 8 | length): bytes to remove; spans of a document may overlap."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    long_texts = texts.filter(F.octet_length("text") >= LENGTH)
    sample, buckets = _sampled(long_texts)
    tasks = -(-buckets // TASK_BUCKETS)
    by_token = dealt(long_texts.mapInArrow(_deal_by_token(sample, buckets), DEALT), buckets, _deal_by_token_again(sample, buckets))
    with arrow_rows(docs.sparkSession, ROWS):
        found = stored(by_token.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_sort_bucket(hot), _ROWS))
    still_open = found.filter("kind > 0").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "span", "lead")).alias("found"))
    packed = long_texts.mapInArrow(squeeze, "doc_id long, packed binary")
    again = packed.join(still_open.hint("shuffle_hash"), "doc_id").select("doc_id", "packed", "found").mapInArrow(_deal_open(sample, buckets), DEALT)
    by_string = dealt(again, buckets, _deal_open_again(sample, buckets))
    with arrow_rows(docs.sparkSession, ROWS):
        more = stored(by_string.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_sort_strings, _ROWS).select("doc_id", "span"))
    return found.filter("kind = 0").select("doc_id", "span").unionByName(more)


def merge(spans_: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a document's spans; runs that touch are one."""
    out: list[list[int]] = []
    for span in sorted(spans_):
        start, end = span >> 8, (span >> 8) + (span & 255)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs_, sha = [], [], [], []
        for packed, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text, runs = open_text(packed), merge(found or [])
            rest = kept_bytes(text, runs)
            size.append(len(text))
            removed.append(len(text) - len(rest))
            runs_.append(len(runs))
            sha.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def by_document(spans_: DataFrame) -> DataFrame:
    return spans_.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    packed = texts.mapInArrow(squeeze, "doc_id long, packed binary")
    joined = packed.join(by_document(repeated_spans(docs, hot)).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column says which spans go."""
    for batch in batches:
        at, last, out = batch.schema.get_field_index("text"), batch.num_columns - 1, []
        for text, found in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
            if found:
                text = kept_bytes(text.encode(), merge(found)).decode(errors="ignore")
            out.append(text)
        yield batch.set_column(at, "text", pa.array(out, pa.string())).select(range(last))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes cut out of text (and n_chars, if there is one, set anew); all rows stay. Where
    a cut goes through a character, what is left of the character's bytes goes too."""
    doc, gone = free_name("__doc", docs.columns), free_name("__spans", docs.columns)
    found = by_document(repeated_spans(docs)).withColumnsRenamed({"doc_id": doc, "spans": gone})
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found[doc], "left").drop(doc)
    cut = joined.mapInArrow(trimmed(_clean), docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
