"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    verdict, details = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), (verdict, details)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
