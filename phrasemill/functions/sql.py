"""Table functions for SQL: phrases, runs and summaries of a value, as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from phrasemill.operators.parsers import PARSERS
from phrasemill.operators.suffix_index import runs


class PhraseRows:
    def eval(self, data: bytes, algo: str) -> Iterator[tuple]:
        at = 0
        for number, (kind, ref, src, length, lit) in enumerate(PARSERS[algo].encode(bytes(data or b""))):
            yield number, at, kind, ref, src, length, lit
            at += length


class RunRows:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from runs(bytes(data or b""))


def register(spark: SparkSession) -> None:
    """phrases(binary, algorithm) and maximal_runs(binary), to be used with LATERAL."""
    spark.udtf.register("phrases", udtf(PhraseRows, returnType="phrase_no long, pos long, kind string, ref long, src long, len long, lit int"))
    spark.udtf.register("maximal_runs", udtf(RunRows, returnType="start long, period long, length long"))
