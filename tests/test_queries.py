"""Every query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(repr([None if v is None or v != v else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == plain([r[i] for i in at] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
