"""DataFrame forms: sources and sinks, streaming in several batches, statistics, the package without llm."""

import random
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import jvm, parsers
from phrasemill.operators.container import compress, decompress
from phrasemill.operators.phrases import decode, parse, phrase_rows, round_trip, statistics
from phrasemill.operators.topk import topk_mergeable, topk_sequential
from phrasemill.session import clear, stored
from phrasemill.sources.files import block_table, byte_files, measured, read_parsed, write_parsed
from phrasemill.streaming import summaries
from phrasemill.streaming.summaries import last_of, run_to_end, stream_table, streaming_prefixes, streaming_topk

FOLDER = "/root/testdata/sf0.001"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abcabcabc")
    files = byte_files(spark, str(tmp_path / "*.bin"), prefix=6)
    assert bytes(files.first().b) == b"abcabc"
    docs = spark.createDataFrame([(1, bytearray(b"abcabcabc")), (2, bytearray(b"")), (3, None)], "k long, b binary")
    write_parsed(parse(docs, "lz77"), str(tmp_path / "parsed"), "lz77")
    parsed, algo = read_parsed(spark, str(tmp_path / "parsed"))
    back = {r.k: bytes(r.b) for r in decode(parsed, algo).collect()}
    assert back == {1: b"abcabcabc", 2: b"", 3: b""}
    assert block_table(spark, FOLDER, "benchmark", "item_id", "text", 64).agg(F.max(F.octet_length("bytes"))).first()[0] == 64
    assert measured(lambda: docs, algo="x").first().rows == "3"


def test_statistics_and_positions(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abababx")), (2, bytearray(b""))], "k long, b binary")
    parsed = parse(docs, "lz77")
    rows = {r.k: r for r in statistics(parsed, "k").collect()}
    assert (rows[1].n_phrases, rows[1].n_refs, rows[1].longest, rows[1].avg_ref_len) == (4, 1, 4, 4.0)
    assert rows[2].n_phrases == 0 and rows[2].avg_ref_len is None
    assert [r.pos for r in phrase_rows(parsed, "k").orderBy("pos").collect()] == [0, 1, 2, 6]


def test_mergeable_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "x string")
    assert topk_mergeable(empty, "x", 5).count() == 0


def test_stream_in_batches_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "event_type", "user_id")
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events"))
    files = sorted((tmp_path / "events").glob("part-*"))
    for i, f in enumerate(files):  # the source reads older files first
        subprocess.run(["touch", "-d", f"2020-01-0{i + 1}", f], check=True)
    stream = stream_table(spark, str(tmp_path / "events"))
    found = last_of(run_to_end(streaming_topk(stream, "event_type", "user_id", "event_id", 20, 64), "batches", "update"), "event_type")
    wanted = topk_sequential(events, "event_type", "user_id", "event_id", 20, 64)
    key = lambda r: (r.event_type, r.user_id, r.n)
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.collect()))
    texts = stream_table(spark, str(tmp_path / "events")).select(F.lit(0).alias("k"), "event_id", F.encode("event_type", "UTF-8").alias("b"))
    assert last_of(run_to_end(streaming_prefixes(texts, "k", "b", "event_id", 30), "prefixes", "update"), "k").count() > 5


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and rows[0].c >= rows[-1].c
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_stands_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = (
        "import shutil, sys; "
        f"shutil.copytree({str(root)!r}, {str(tmp_path / 'copy')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__')); "
        f"sys.path.insert(0, {str(tmp_path / 'copy')!r}); import __spark_entry__ as e; "
        "assert 'topk_grams_exact' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert e.oracle_sql(); "
        "from phrasemill.session import local_session; assert e.entry(local_session(2)).count() == 20"
    )
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "tests/test_sequences.py"], check=True, cwd=tmp_path / "copy")


def test_falling_positions_are_refused(spark):
    late = summaries.staged(spark.createDataFrame([(1, 5, b"abc", 0), (1, 9, b"abd", 1), (1, 7, b"x", 2)], "k long, p long, b binary, came int"), "came", 3)
    with pytest.raises(Exception, match="came after"):
        summaries.run_to_end(summaries.streaming_lz78(late, "k", "b", "p"), "late", "append")


def test_metrics_of_containers(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("n", F.octet_length("b"))
    row = measured(lambda: compress(docs, "lz78"), algo="lz78").first()
    total = docs.agg(F.sum("n")).first()[0]
    assert list(row.asDict()) == ["algo", "memory", "n", "nout", "ratio", "rows", "time"] and int(row.n) == total
    assert float(row.ratio) == round(int(row.nout) / total, 4) < 1 and int(row.memory) > 1 << 20
    assert decompress(compress(docs, "lz78")).exceptAll(docs.select("doc_id", "n", "b")).count() == 0


def test_stored_tables_are_cleared(spark):
    rows = stored(spark.range(3))
    assert rows.count() == 3 and clear(spark) >= 1 and clear(spark) == 0


@pytest.mark.parametrize("options", [{"k": 512}, {"k": 5}, {"k": 9, "max_freq": 8}, {"k": 40, "window": 3, "max_freq": 2}, {"k": 2, "window": 1}])
def test_phrases_of_the_jvm_are_those_of_the_plain_program(spark, options):
    draw = random.Random(5)
    texts = [None, b"", b"a", b"\xff\0" * 40, b"abracadabra" * 30] + [bytes(draw.choices(range(97, 97 + n), k=20 * n)) for n in range(1, 60)]
    texts += [x.b for x in spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.encode("text", "UTF-8").alias("b")).limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, b binary")
    parsed = jvm.selective_parse(rows, **options)
    for row in parsed.collect():
        phrases = parsers.encode_selective(bytes(texts[row.key] or b""), **options)
        wanted = [p[1] if p[0] == "trie" else -1 - p[4] for p in phrases]
        assert list(struct.unpack(f">{len(row.packed) // 4}i", row.packed)) == wanted
    back = {r.key: bytes(r.b) for r in round_trip(rows, "topk_sel", **options).collect()}
    assert back == {i: bytes(x or b"") for i, x in enumerate(texts)}


def test_the_selective_round_trip_runs_no_python(spark):
    rows = spark.createDataFrame([(1, b"abab")], "key int, b binary")
    plan = round_trip(rows, "topk_sel", k=512)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "selective" in plan.lower()
