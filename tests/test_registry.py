"""Every registered query next to its DuckDB statement, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from registry.compare import difference, oracle_connection
from registry.model_queries import MODEL_QUERIES
from registry.operator_queries import OPERATOR_QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {**MODEL_QUERIES, **OPERATOR_QUERIES}


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_every_query_has_a_statement():
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, connection, name):
    query, statement = contract.queries()[name], contract.oracle_sql()[name]
    assert difference(spark, connection, SF_DIR, query, statement) is None


def test_no_query_plans_a_cross_join(spark):
    for name, query in QUERIES.items():
        plan = query(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name


def test_marts_read_the_columns_they_need(spark):
    """Filters reach the Parquet scan, and so does the column selection."""
    query = contract.queries()["mart_vs_big3_h2h"](spark, SF_DIR)
    plan = query._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "opponent_id" in line)
    assert "tourney_name" not in scan.split("ReadSchema")[1]
    assert "EqualTo(is_incomplete,false)" in scan or "Not(" in scan
