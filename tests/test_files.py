"""Archive pruning by a strategy table, and rows that stand more than once."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from flowlure.operators import drop_repeated_rows, strategy_long
from flowlure.plans import catalog, files
from flowlure.plans.persist import materialize
from flowlure.sources import read_flow_archive, read_flows_of_days, strategy_records_fixture


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_the_strategies_prune_the_archive(spark):
    root = files.archive(spark, SF_SMALL)
    days = files.evaluated_days(strategy_long(strategy_records_fixture(catalog.eval_base(spark, SF_SMALL))))
    found = read_flows_of_days(spark, root, materialize(days, "days"))
    assert "dynamicpruning" in plan(found.where(F.col("Proto") == "tcp"))
    chosen = {str(r["day"]) for r in days.collect()}
    assert 0 < len(chosen) < 10
    rows = found.select(F.replace(F.substring("StartTime", 1, 10), F.lit("/"), F.lit("-")).alias("d")).groupBy("d").count().collect()
    assert {r["d"] for r in rows} == chosen
    every = read_flow_archive(spark, root)
    assert sum(r["count"] for r in rows) == every.where(F.replace(F.substring("StartTime", 1, 10), F.lit("/"), F.lit("-")).isin(*chosen)).count()
    scans = [m for m in _scans(found)]
    assert scans and all(0 < n <= len(chosen) for n in scans), scans  # folders read, of thirty
    assert read_flows_of_days(spark, root, days.limit(0)).count() == 0


def _scans(df):
    """Partitions read by each file scan of the executed plan."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            out.append(node.metrics().apply("numPartitions").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def repeated(spark):
    values = [("a", None, 1), (None, "a", 1), ("a", None, 1), (None, None, None), (None, None, None), ("b", "", 2), ("b", None, 2), ("x", "y", 3)] + [("hot", "row", 9)] * 400
    return spark.createDataFrame(values, "s string, `t.u` string, n int").repartition(6)


def test_repeated_rows_go(spark, repeated):
    for share in (lambda df, name: df, materialize):
        assert rows(drop_repeated_rows(repeated, share)) == rows(repeated.distinct())
    assert drop_repeated_rows(repeated.limit(0)).count() == 0


def test_rows_that_share_a_hash_both_stay(spark, repeated, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert rows(drop_repeated_rows(repeated)) == rows(repeated.distinct())


def test_only_hashes_are_shuffled(spark):
    """Of the rows that stand alone none is shuffled; the hashes are, as partial counts."""
    raw = catalog.raw_flows(spark, SF_CHECK)
    found = plan(drop_repeated_rows(raw, materialize))
    assert found.count("BroadcastHashJoin") >= 2
    shuffles = [line for line in found.splitlines() if "hashpartitioning" in line]
    assert len(shuffles) == 1 and "SrcAddr" in shuffles[0]  # what is left of the repeated rows after each task's own


def test_limits_cut_and_both_verdicts_occur(spark):
    """The scattered flows have more ports than every limit, ties at the cut, and shares under 1."""
    stats = catalog.scattered_stats(spark, SF_CHECK).collect()
    assert len({r["port"] for r in stats}) > 100 and max(r["open_port_probability"] for r in stats) < 0.5
    top = catalog.QUERIES["scattered_top_ports"](spark, SF_CHECK).collect()
    by_day = {}
    for r in top:
        by_day.setdefault(r["day"], []).append(r)
    assert all(len(v) == 25 for v in by_day.values())
    tied = 0
    for day, kept in by_day.items():
        last = max(kept, key=lambda r: r["rank"])
        left = [r for r in stats if r["day"] == day and r["port"] not in {k["port"] for k in kept}]
        tied += any(r["attack_probability"] == last["attack_probability"] for r in left)
        assert all(r["port"] > last["port"] for r in left if r["attack_probability"] == last["attack_probability"])
    assert tied
    assert catalog.QUERIES["scattered_average_attackers"](spark, SF_CHECK).count() == 100
    assert {r["feasible"] for r in catalog.QUERIES["scattered_scoring"](spark, SF_CHECK).select("feasible").collect()} == {True, False}
