"""Queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted((tuple(map(repr, r)) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({entry.oracle_sql()[name]}) q").fetchall()
    assert _plain(map(tuple, got.select(*columns).collect())) == _plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
