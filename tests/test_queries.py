"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference

import __spark_entry__ as entry
from docutally.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(SQL) and set(SQL) <= set(entry.queries())


# The queries of the optional training-data part have tests of their own.
@pytest.mark.parametrize("name", REGISTRY)
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), SF, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
