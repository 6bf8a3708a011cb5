"""Joins of flows with derived tables: what is shuffled while those are small, and beyond."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlure.operators import attacker_flows, honeypot_assignment
from flowlure.operators.timeline import count_after, later_parts
from flowlure.plans import catalog
from flowlure.plans.persist import materialize


@contextlib.contextmanager
def settings(spark, **values):
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


SHUFFLED = {"autoBroadcastJoinThreshold": "-1", "adaptive__autoBroadcastJoinThreshold": "-1"}


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flows_stay_in_place_while_the_key_side_is_small(spark):
    """The plan before anything runs already broadcasts the attackers, and nothing else moves."""
    found = plan(catalog.QUERIES["attacker_flows"](spark, SF_SMALL))
    assert "BroadcastHashJoin LeftSemi" in found and "hashpartitioning" not in found


def test_assignment_moves_no_flow_and_one_row_per_day_and_port(spark):
    found = plan(catalog.QUERIES["honeypot_assignment"](spark, SF_SMALL))
    assert "hashpartitioning" not in found and found.count("BroadcastHashJoin") >= 2
    base = catalog.eval_base(spark, SF_SMALL)
    att, strat = attacker_flows(catalog.without_null_ports(base)), catalog.strategies_from(base)
    kept = {}

    def share(df, name):
        kept[name] = materialize(df, name)
        return kept[name]

    honeypot_assignment(att, strat, share=share)
    rows = kept["setups"].collect()
    assert len(rows) == len({(r["day"], r["Dport"]) for r in rows}) and {len(r["setups"]) for r in rows} == {4}


@pytest.mark.parametrize("mode", ["prob", "ratio"])
def test_shuffled_and_broadcast_plans_agree(spark, mode):
    def rows():
        base = catalog.eval_base(spark, SF_SMALL)
        att = attacker_flows(catalog.without_null_ports(base))
        return sorted(map(str, honeypot_assignment(att, catalog.strategies_from(base), mode=mode).collect()))

    small = rows()
    with settings(spark, **SHUFFLED):
        assert rows() == small and small


def test_a_hot_source_is_split(spark):
    """With both sides shuffled, AQE splits the flows of a source that holds most of them."""
    flows = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 997).cast("string"))).alias("SrcAddr"),
        F.lit("2024-01-01").cast("date").alias("day"), F.md5(F.col("id").cast("string")).alias("DstAddr"), (F.col("id") % 50).cast("int").alias("Dport"))
    with settings(spark, **SHUFFLED, adaptive__skewJoin__skewedPartitionThresholdInBytes="64k", adaptive__skewJoin__skewedPartitionFactor="2", adaptive__advisoryPartitionSizeInBytes="64k"):
        found = attacker_flows(flows)
        assert found.count() == 400_000
        joined = found.groupBy("Dport").count()  # runs the join under an aggregate, as its readers do
        joined.collect()
        assert re.search(r"SortMergeJoin\(skew=true\).*LeftSemi", tree(joined)), tree(joined)


def test_events_are_counted_before_they_move(spark):
    """The exchange of events is above a partial count, also where a join dealt them by the bare keys."""
    with settings(spark, **SHUFFLED):
        flows = catalog.eval_flows(spark, SF_SMALL)
        att = attacker_flows(flows)
        marks = flows.groupBy("SrcAddr", "day").agg(F.min("ts").alias("ts"))
        found = later_parts(marks, att, ["SrcAddr", "day"], ["SrcAddr", "day"])
        lines = tree(found).splitlines()
    at = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(_k#\d+, _m#\d+, _u#\d+", line)]
    assert at and all("partial_count(1)" in lines[i + 1] for i in at)
    windows = re.findall(r"Window .*windowspecdefinition\(([^)]*)\)", "\n".join(lines))
    assert len(windows) == 2 and not any(w.startswith("SrcAddr") for w in windows)


def test_a_flood_within_a_minute(spark):
    events = spark.sql("SELECT 'a' AS s, DATE'2024-01-02' AS day, TIMESTAMP_NTZ'2024-01-02 10:00:30' + make_dt_interval(0, 0, 0, id % 20 + 0.000001 * (id % 7)) AS ts FROM range(2000)")
    marks = events.where("ts >= TIMESTAMP_NTZ'2024-01-02 10:00:40'").distinct().withColumn("m", F.col("ts"))
    got = {r["m"]: r["later"] for r in count_after(marks, events, ["s", "day"], ["s", "day", "m"]).collect()}
    times = [r["ts"] for r in events.collect()]
    want = {m: n for m in {r["m"] for r in marks.collect()} if (n := sum(t > m for t in times))}
    assert got == want and len(got) > 60
