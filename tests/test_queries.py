import os

import oracle
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    status, _, note = oracle.compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert status in ("exact", "close") and not note, note


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 6


@pytest.mark.parametrize("name", ["demand_series", "select_by_role", "backtest_end_to_end", "minmax_fit"])
def test_queries_agree_without_any_automatic_broadcast(spark, con, name):
    """Totals per part meet the parts by a shuffled join."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        status, _, note = oracle.compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert status in ("exact", "close") and not note, note
