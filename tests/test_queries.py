"""Every registered query equals its SQL."""

from __future__ import annotations

import pytest
from tests_support import SF, compare

from tessera.plans import data_queries, queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

assert data_queries and queries  # they register


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["package", "signup", "error", "purchase"]
