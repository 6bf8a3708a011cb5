"""Properties that must hold whatever the data."""

from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from flowlure.operators import (
    attack_probability_daily,
    attacker_flows,
    first_detection,
    honeypot_assignment,
    saved_flows,
)
from flowlure.plans import catalog


def test_attack_probability_bounds(spark):
    df = attack_probability_daily(catalog.wide_flows(spark, SF_CHECK))
    lo, hi = df.agg(F.min("attack_probability"), F.max("attack_probability")).first()
    assert 0 < lo <= hi <= 1


def test_saved_never_exceeds_total(spark):
    assert catalog.q_saved_flows(spark, SF_CHECK).where(F.col("saved") > F.col("total_attacks")).count() == 0


def test_raising_probabilities_never_delays_detection(spark):
    base = catalog.eval_base(spark, SF_CHECK)
    att = attacker_flows(catalog.without_null_ports(base))
    strat = catalog.strategies_from(base)
    higher = strat.withColumn("prob", F.least(F.lit(1.0), F.col("prob") + 0.2))
    old = first_detection(honeypot_assignment(att, strat)).withColumnRenamed("detection_time", "old")
    new = first_detection(honeypot_assignment(att, higher)).withColumnRenamed("detection_time", "new")
    joined = old.join(new, ["SrcAddr", "strategy_id", "day"], "left")
    assert joined.where(F.col("new").isNull() | (F.col("new") > F.col("old"))).count() == 0
    assert new.count() >= old.count()


def test_result_independent_of_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(tuple(r) for r in catalog.q_fixed_strategy_daily_results(spark, SF_SMALL).collect())
        b_saved = sorted(tuple(r) for r in catalog.q_saved_flows(spark, SF_SMALL).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        c = sorted(tuple(r) for r in catalog.q_fixed_strategy_daily_results(spark, SF_SMALL).collect())
        d_saved = sorted(tuple(r) for r in catalog.q_saved_flows(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == c and b_saved == d_saved


def test_rolls_are_stable_across_runs(spark):
    a = sorted(tuple(r) for r in catalog.q_honeypot_assignment(spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in catalog.q_honeypot_assignment(spark, SF_SMALL).collect())
    assert a == b


def test_results_independent_of_session_time_zone(spark):
    names = ["prepared_flows", "first_detection", "fixed_strategy_daily_results"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = {}
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results[zone] = {n: sorted((tuple(r) for r in catalog.QUERIES[n](spark, SF_SMALL).collect()), key=repr)
                             for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert results["UTC"] == results["America/Los_Angeles"] == results["Asia/Kolkata"]
