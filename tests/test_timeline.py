"""count_after equals the brute-force join count, including same-minute ties."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowlure.operators.timeline import count_after


def test_count_after_matches_brute_force(spark):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 2, 10, 0)
    events, marks = [], []
    for src in ("a", "b", "c"):
        for _ in range(300):
            events.append((src, dt.date(2024, 1, 2), base + dt.timedelta(seconds=rng.randint(0, 600))))
        for k in range(4):
            marks.append((src, dt.date(2024, 1, 2), f"s{k}", base + dt.timedelta(seconds=rng.randint(0, 600))))
    events.append(("a", dt.date(2024, 1, 2), None))
    marks.append(("a", dt.date(2024, 1, 2), "null", None))
    marks.append(("a", dt.date(2024, 1, 2), "tie", events[0][2]))
    ev = spark.createDataFrame(events, "SrcAddr string, day date, ts timestamp_ntz")
    mk = spark.createDataFrame(marks, "SrcAddr string, day date, strategy_id string, ts timestamp_ntz")
    got = {(r.SrcAddr, r.strategy_id): r.later for r in
           count_after(mk, ev, ["SrcAddr", "day"], ["SrcAddr", "day", "strategy_id"]).collect()}
    brute = (mk.alias("m").join(ev.alias("e"), ["SrcAddr", "day"])
             .where(F.col("e.ts") > F.col("m.ts")).groupBy("SrcAddr", "strategy_id").count())
    want = {(r.SrcAddr, r.strategy_id): r["count"] for r in brute.collect()}
    assert got == want and ("a", "null") not in got


def test_record_low_reduction_is_exact(spark):
    from conftest import SF_CHECK
    from flowlure.operators import attacker_flows, detections, first_detection, honeypot_assignment
    from flowlure.plans import catalog

    base = catalog.eval_base(spark, SF_CHECK)
    att = attacker_flows(catalog.without_null_ports(base))
    strat = catalog.strategies_from(base)
    for mode in ("prob", "ratio"):
        fast = sorted(tuple(r) for r in detections(att, strat, mode=mode).collect())
        slow = sorted(tuple(r) for r in first_detection(honeypot_assignment(att, strat, mode=mode)).collect())
        assert fast == slow, mode


def test_record_lows_of_a_hot_group(spark):
    from flowlure.operators import record_low_flows

    rng = random.Random(3)
    base = dt.datetime(2024, 1, 2, 10, 0)
    rows = [("s", dt.date(2024, 1, 2), 22, base + dt.timedelta(seconds=rng.randint(0, 3600)), rng.random())
            for _ in range(5000)]
    df = spark.createDataFrame(rows, "SrcAddr string, day date, Dport int, ts timestamp_ntz, roll double")
    lows = sorted((r.ts, r.roll) for r in record_low_flows(df).collect())
    best, want = 2.0, []
    for ts, roll in sorted((r[3], r[4]) for r in rows):
        if roll < best:
            want.append((ts, roll))
            best = roll
    assert lows == want and len(lows) < 50


def test_minute_keyed_window_has_its_own_exchange(spark):
    import contextlib
    import io
    import re

    from conftest import SF_SMALL
    from flowlure.operators import attacker_flows, detections
    from flowlure.plans import catalog

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")  # large-table plan: shuffle joins everywhere
        base = catalog.eval_base(spark, SF_SMALL)
        det = detections(attacker_flows(catalog.without_null_ports(base)), catalog.strategies_from(base))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            det.explain("formatted")
        plan = buf.getvalue()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin LeftSemi" in plan
    args = re.findall(r"Arguments: (hashpartitioning\([^)]*\)[^\n]*REPARTITION_BY_COL)", plan)
    assert any("Dport" in a and "_m" in a and "SrcAddr" in a and "day" in a for a in args), args
