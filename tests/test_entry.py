"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
