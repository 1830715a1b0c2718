from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from answerlog.plans import base
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = base.QUERIES, base.SQL  # the part for training data has tests of its own


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, name, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_points_hold_all_queries():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
