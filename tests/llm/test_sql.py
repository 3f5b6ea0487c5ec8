"""Registered queries against their SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from creditloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    result = tables.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    assert sorted(found.columns) == columns
    places = [[c[0] for c in result.description].index(c) for c in columns]
    form = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    expected = sorted((tuple(form(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(form, r)) for r in found.select(*columns).collect()), key=repr) == expected
