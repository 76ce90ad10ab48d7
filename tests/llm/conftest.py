import pytest
from pyspark.sql import functions as F


@pytest.fixture
def awkward(spark):
    """Documents with nulls, empties, ties, repeated rows, a very long text, and clashing extra columns."""
    line = "the cat sat on the mat and looked at the rain for a very long time indeed"
    rows = [
        (1, line + "\nsecond line of the first document which is quite different from it", "a"),
        (2, line + "\nsecond line of the first document which is quite different from it", "a"),
        (2, line + "\nsecond line of the first document which is quite different from it", "a"),
        (3, None, None),
        (4, "", "b"),
        (5, " \n\t\n", "b"),
        (6, "ünïcödé ▁ words and <|endoftext|> \\ # < & signs \x01 here", "c"),
        (7, "\n".join(f"row {i} of a long text, " + "word " * (i % 9) for i in range(4000)), "c"),
        (8, "x" * 9000, None),
        (None, line, "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", F.lit(1).alias("n_words"), F.lit("k").alias("kept"), F.lit(2).alias("fp"), F.lit(3).alias("spans"), F.lit(0).alias("bucket"))


@pytest.fixture
def none(awkward):
    return awkward.filter("false")
