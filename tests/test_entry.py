"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.meetings > 1 for r in rows)
