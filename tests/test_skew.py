"""A third of all rows from one source: results still equal the SQL statements."""

import pytest

from conftest import SF_CHECK
from flowlure.plans.compare import compare

HOT_QUERIES = ["daily_attackers", "attack_probability_daily", "first_detection", "saved_flows",
               "port_hit_summary", "fixed_strategy_daily_results", "strategy_pair_comparison",
               "unused_hosts_per_port"]


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    out = str(tmp_path_factory.mktemp("skewed"))
    events = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(3)).otherwise(F.col("user_id")))
    hot.coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_source(spark, skewed_dir, name):
    con = duckdb_connection_events(skewed_dir)
    r = compare(spark, skewed_dir, name, con)
    assert r["values_match"], r


def duckdb_connection_events(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet/*.parquet')")
    return con
