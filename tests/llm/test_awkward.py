"""Defined results of every operator on awkward rows and on empty tables."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import chat, html, lines, packing, pieces, quality, sharding, simhash, suffixes, topk

IDS = 10


def test_quality(awkward, none):
    rows = quality.quality_rules(awkward).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == IDS and by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[1].kept and by[7].n_words > 10_000 and by[8].word_chars == 9000
    assert quality.quality_rules(none).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_simhash(awkward, none):
    rows = simhash.near_duplicates(awkward).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == IDS and by[1].component_id == by[2].component_id == 1
    assert by[3].fingerprint == "0" * 16 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(awkward).collect() if r.doc_id) == [1, 3, 6, 7, 8]


def test_lines(awkward, none):
    by = {r.doc_id: r for r in lines.digests(awkward).collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == 2 and by[2].first_docs == [1] and by[3].n_lines == 0
    assert by[None].n_removed == 0
    assert lines.digests(none).count() == 0
    kept = lines.drop_repeated_lines(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_suffixes(awkward, none):
    by = {r.doc_id: r for r in suffixes.digests(awkward).collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes and by[3].n_bytes == 0
    assert by[8].n_removed == 0  # it only repeats itself
    assert by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffixes.digests(none).count() == 0
    cut = suffixes.remove_repeats(awkward)
    assert cut.columns == awkward.columns and cut.count() == IDS


def test_packing(awkward, none):
    rows = packing.pack(awkward, keep_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and max(r.length for r in rows) <= 4096
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 4096
    assert packing.pack(none).count() == 0


def test_pieces(awkward, none):
    encoded = pieces.encode(awkward)
    texts = sorted((r.doc_id or 0, r.text or "") for r in awkward.collect())
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decode(encoded).collect()) == texts
    assert pieces.encode(none).count() == 0


def test_sharding(awkward, none):
    rows = sharding.place(awkward.withColumnRenamed("bucket", "placement"), "doc_id").collect()
    by = {r.doc_id: r.placement for r in rows}
    assert len(rows) == IDS and len({r.placement for r in rows if r.doc_id == 2}) == 1 and by[None].shard in sharding.SHARDS
    assert sharding.place(none, "doc_id").count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi # < \\h \\\\"), (1, 1, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "</turn>\n### user:\n"), (1, 2, "assistant", "</turn>\n### user:\n"), (None, 0, "a:\nb", "<+>"), (2, None, "assistant", "")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(rows.withColumn("formatted", rows.role))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat.read_back(formatted.formatted).alias("turns")).collect()}
    assert back[1] == [("user", "hi # < \\h \\\\"), ("", "x"), ("user", ""), ("assistant", "</turn>\n### user:\n"), ("assistant", "</turn>\n### user:\n")]
    assert back[None] == [("a:\nb", "<+>")] and back[2] == [("assistant", "")]
    loss = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert loss[1].loss_sha256 == hashlib.sha256(b"</turn>\n### user:\n" * 2).hexdigest() and loss[1].n_turns == 5
    assert chat.format_chats(rows.filter("false")).count() == 0


def test_long_conversations(spark):
    import time

    roles = ["user", "assistant", "assistant", "tool"]
    rows = spark.range(20_000).selectExpr("id % 2 conv_id", "id turn", "element_at(array('user', 'assistant', 'assistant', 'tool'), cast(id div 2 % 4 + 1 as int)) role", "concat('é#', id, '<') text")
    start = time.time()
    found = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    digests = {r.conv_id: r for r in chat.digests(chat.format_chats(rows)).collect()}
    assert time.time() - start < 20
    for c in (0, 1):
        turns = [(roles[i // 2 % 4], f"é#{i}<") for i in range(c, 20_000, 2)]
        said = [t for r, t in turns if r == "assistant"]
        spans = [found[c].formatted[s.start : s.end] for s in found[c].loss_spans]
        assert [s.replace("\\h", "#").replace("\\l", "<") for s in spans] == said
        assert digests[c].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest() and digests[c].n_turns == 10_000


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, "<p>just a few words here</p>"), (3, "u", "<p " * 2000)], "page_id long, url string, html string")
    by = sorted((r.page_id, r.text, r.n_chars) for r in html.main_texts(pages).collect())
    assert by[:3] == [(1, "", 0), (2, "", 0), (2, "just a few words here", 21)] and len(by) == 4
    assert html.main_texts(pages.filter("false")).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5]), (8, []), (None, [1.0, 1.0]), (50, [-1.0, 2.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "0 as v", "1 as score")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(rows, rows.filter("vec_id % 50 = 0")).collect())
    assert found[:5] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 7, 32768), (0, 5, 8, 0)]
    assert [x[2] for x in found[5:]] == [8, 7, 0, 1, 2] and len(found) == 10
    assert topk.top_k(rows.filter("false"), rows.filter("false")).count() == 0


def test_names_that_clash(awkward):
    named = awkward.selectExpr("*", "'a' as __gone", "'b' as __doc", "'c' as __spans", "'d' as row", "'e' as body", "'f' as stays")
    for stage in (quality.keep_good, lines.drop_repeated_lines, simhash.keep_one, suffixes.remove_repeats):
        found = stage(named)
        assert found.columns == named.columns and {tuple(r)[-6:] for r in found.collect()} == {tuple("abcdef")}


def test_place_under_another_name(awkward):
    rows = sharding.place(awkward.withColumn("placement", F.lit("mine")), "doc_id", out="spot").collect()
    assert {r.placement for r in rows} == {"mine"} and all(r.spot.shard in sharding.SHARDS for r in rows)
    with pytest.raises(ValueError):
        sharding.place(awkward, "doc_id", out="doc_id")


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward, none):
    for docs in (awkward.withColumn("n_chars", F.lit(0).cast("long")), none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, "")
            assert found.columns == docs.columns, name
            found.collect()
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, "").columns


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    none.select("doc_id", "text", "source").withColumn("n_chars", F.lit(0).cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_keep_no_words_once_pieces_have_places():
    packing.encoder(packing.TOKENIZER).encode([b"some words of a text"])
    assert list(packing._place(packing.slots(packing.local_search(packing.alone({5: 1}), 20)), 5)(iter([]))) == []
    assert packing.encoder.cache_info().currsize == 0


def test_very_long_rows(spark):
    page = "<article>" + "<p>some words of a long page</p>" * 20_000 + "</article>"
    assert html.extract(page).count("\n") == 19_999
    rows = spark.createDataFrame([(0, [1.0] * 5000), (1, [0.5] * 5000), (2, [0.25])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(rows, rows.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 256 * 128 * 5000), (2, 256 * 64)]
    text = "word " * 300_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, text + "\n" + "x" * 400_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in quality.quality_rules(docs).collect()} == {1: 300_001, 2: 300_002}
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()} == {1: text, 2: text + "\n" + "x" * 400_000}
    assert sum(r.length for r in packing.pack(docs).collect() if r.doc_id == 1) == 300_002
    assert {r.doc_id: r.n_removed for r in suffixes.digests(docs).collect()} == {1: 0, 2: len(text)}
    assert {r.doc_id: r.n_removed for r in lines.digests(docs).collect()} == {1: 0, 2: 1}
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} <= {1, 2}
