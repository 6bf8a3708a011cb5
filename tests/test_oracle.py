"""Every registered query equals its SQL statement (DuckDB) value for value."""

import pytest

from conftest import SF_CHECK, SF_SMALL
from flowlure.plans import catalog, files
from flowlure.plans.compare import compare, duckdb_connection
from flowlure.plans.oracle import ORACLE_SQL

QUERIES = catalog.QUERIES | files.QUERIES


@pytest.fixture(scope="module")
def con_small():
    return duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql_sf0001(spark, con_small, name):
    r = compare(spark, SF_SMALL, name, con_small)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


@pytest.mark.parametrize("name", ["first_detection", "saved_flows", "fixed_strategy_daily_results",
                                  "strategy_pair_comparison", "daily_statistics_document", "strategy_sweep_certified",
                                  "scattered_scoring"])
def test_query_matches_sql_sf001(spark, name):
    r = compare(spark, SF_CHECK, name)
    assert r["values_match"], r


def test_every_query_but_the_sweep_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"strategy_sweep"}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_documented_row_counts(spark):
    counts = {n: QUERIES[n](spark, SF_CHECK).count() for n in
              ("prepared_flows", "daily_attackers", "attacker_flows", "first_detection")}
    assert counts == {"prepared_flows": 6941, "daily_attackers": 679, "attacker_flows": 2450,
                      "first_detection": 812}


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) == {"rationality", "num_of_hp", "avg_saved_ratio", "stddev"}
    assert df.count() >= 0
