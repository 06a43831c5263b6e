"""Every query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (float, decimal.Decimal)):
        return ("number", round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((plain(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in catalog.oracles():
        assert rows
        return
    cursor = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert columns == sorted(names)
    assert rows == sorted((plain(tuple(r[i] for i in order)) for r in cursor.fetchall()), key=repr)
