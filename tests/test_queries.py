"""Every registered query against its SQL on the smallest tables."""

import pytest

import checks
from checks.compare import compare, connect

NAMES = sorted(checks.queries())


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    ok, message = compare(spark, duck, small, name, checks.queries()[name], checks.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
