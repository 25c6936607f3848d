"""Every query with reference SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import compare


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "p50" in df.columns


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == "ok"
