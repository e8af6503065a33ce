"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillmill.queries import ORACLES, QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        assert got == table([d[0] for d in found.description], found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
