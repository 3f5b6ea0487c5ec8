"""Every registered query against its SQL form on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    wanted = [dict(zip(order, r)) for r in result.fetchall()]
    theirs = sorted((tuple(r[c] for c in columns) for r in wanted), key=repr)
    assert sorted(order) == columns
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == described
    assert mine == theirs
    assert mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert rows
    for row in rows:
        for value in row:
            assert not (isinstance(value, float) and math.isnan(value))


def test_entry(spark):
    assert entry_module.entry(spark).count() == 11
