"""Every registered query against its reference SQL."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_points
import oracle_queries
from panelscope.plans.queries import all_queries

QUERIES, SQL = all_queries(), oracle_queries.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf):
    return compare.connect(sf)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["inst_id", "year", "total_rd", "national_rank"] and df.count() == 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_reference_sql(spark, tables, sf, name):
    assert compare.differences(QUERIES[name](spark, sf), tables, SQL[name]) is None
