"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from occura.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.sql("set timezone='UTC'")
    for name in os.listdir(SF_DIR):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF_DIR}/{name}'")
    return connection


def _plain(value):
    if value is None or value != value:
        return None
    return round(value, 9) if isinstance(value, float) else value


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query(spark, oracle, key):
    found = registry.queries()[key](spark, SF_DIR)
    sql = registry.oracle_sql().get(key)
    if sql is None:
        assert found.count() > 0
        return
    expected = oracle.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    order = [expected.columns.index(n) for n in names]
    wanted = [tuple(r[k] for k in order) for r in expected.fetchall()]
    assert _rows(map(tuple, found.select([f"`{n}`" for n in names]).collect())) == _rows(wanted)
