"""A training corpus in five stages: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of documents.

Defined results: rows with a null or empty text are rejected by the quality rules; rows without doc_id pass the
line and span stages as they are; rows that repeat a doc_id are the same document; very long texts are taken whole;
further columns, whatever their names, pass up to the last stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasemill.llm import lines, packing, quality, simhash, suffixes
from phrasemill.session import ship, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or nearly, go; a document of which nothing is left goes too."""
    ship(spark)
    return lines.drop_repeated_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    ship(spark)
    return simhash.keep_one(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 50 bytes or more that a document with a smaller doc_id holds are cut out of the text."""
    ship(spark)
    return suffixes.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document stands."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_spans),
    ("best-fit packing", pack),
]
#: SQL cannot express the tokenizer, the fingerprints or the edit join; the tests hold the stages against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
