"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from phrasemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and (math.isnan(value) or value == int(value)):
        return None if math.isnan(value) else int(value)
    return value


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER).toPandas()
    wanted = duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))


def test_every_query_runs_without_sql(spark):
    for name in set(catalog.queries()) - set(SQL):
        assert catalog.queries()[name](spark, FOLDER).count() > 0
