"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: Filters of a report page that need not match anything in the smallest tables.
MAY_BE_EMPTY = {"user_detail_logs", "user_detail_alerts", "user_detail_alerts_every_rule", "user_detail_values"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, small, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES[name], small)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
