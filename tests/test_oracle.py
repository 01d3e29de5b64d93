"""Every registered query with a DuckDB statement must give the same rows at the smallest scale."""

import compare
import pytest
from helpers import SMALL

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


# Queries that train the boosted models in full take minutes; test_models and test_tree_attribution test them in small.
TRAINED = {"attribution_additivity", "ranking_rules", "what_if_rules"}


@pytest.mark.parametrize("name", sorted(set(SQL) - TRAINED))
def test_same_rows(spark, connection, name):
    assert compare.differences(QUERIES[name](spark, SMALL), connection, SQL[name]) == []
