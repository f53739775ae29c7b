"""Every registered query against its SQL in DuckDB at the smallest size."""

import os
from collections import Counter

import duckdb
import pytest

from strandwise import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLES[name])
    assert _bag(df.columns, map(tuple, df.collect())) == _bag(found.columns, found.fetchall())
