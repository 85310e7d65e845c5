"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest
from helpers import cells

import __spark_entry__ as entry
from foldspark.oracles import ORACLES
from foldspark.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert cells([r.asDict() for r in got.collect()], sorted(names)) == cells(want, sorted(names))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
