"""Every registered query with a SQL twin is compared with it by value; a result without rows fails."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from barweave.plans.catalog import QUERIES

entry.queries()


#: Without a row in the smallest folder: checked for equality there too, and for rows by the larger runs.
EMPTY_WHEN_SMALL = {"diversification_ratio"}


def picked():
    return [n for n, q in QUERIES.items() if q.sql]


@pytest.mark.parametrize("name", picked())
def test_matches_sql(name, spark, sf, con):
    q = QUERIES[name]
    diff = compare(q.run(spark, sf), con, q.sql)
    assert diff is None or (diff == "no rows" and name in EMPTY_WHEN_SMALL), diff


def test_names_are_unique_and_callable():
    assert set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ticker", "date", "score", "rn", "weight"]
