"""Hand-made cases: state classes, thresholds, time parsing, ties, NULLs, dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import raw_rows
from flowlure.functions import answered, unused_port
from flowlure.operators import (
    attacker_flows,
    daily_attackers,
    first_detection,
    honeypot_assignment,
    prepare_flows,
    saved_flows,
    strategy_long,
    strategy_setup_summary,
)

STATES = {
    # state: (unused, answered)
    "S_SA": (False, True), "FSPA_FSPA": (False, True), "S_RA": (True, False), "S_": (True, False),
    "S_R": (True, False), "SR_A": (True, False), "RA_S": (False, False), "FRA_PA": (True, False),
    "S_SR": (False, False), "A_SPA_RA": (True, True), "SA_AS": (False, False), "INT": (False, False),
    None: (None, None),
}


def test_state_classes(spark):
    df = spark.createDataFrame([(s,) for s in STATES], "State string")
    got = {r.State: (r.u, r.a) for r in df.select("State", unused_port().alias("u"), answered().alias("a")).collect()}
    assert got == STATES


def _flow(src, dst, port, state="S_SA", t="2024/01/02 12:30:00.000001", proto="tcp"):
    return (proto, src, dst, port, state, t)


def test_prepare_filters_and_types(spark):
    rows = [
        _flow("10.0.0.1", "147.32.80.1", "22", t="2024/01/02 12:30:00.000001"),
        _flow("10.0.0.1", "147.32.80.1", "na", t="2024/01/02 14:30:00.5"),
        _flow("10.0.0.1", "147.32.80.1", "", t="2024/01/02 14:30:00"),
        _flow("10.0.0.1", "147.32.80.1", None, t="garbage"),
        _flow("147.32.80.9", "147.32.80.1", "22"),      # inside source: dropped
        _flow("10.0.0.1", "147.32.1.1", "22"),          # outside destination for 147.32.8: dropped
        _flow("10.0.0.1", "147.32.80.1", "22", proto="udp"),  # not tcp: dropped
    ]
    out = prepare_flows(raw_rows(spark, rows), "147.32.8").orderBy("ts").collect()
    assert len(out) == 4
    by_port = {(r.Dport, r.ts, r.day) for r in out if r.ts is not None}
    assert (None, dt.datetime(2024, 1, 2, 14, 30, 0), dt.date(2024, 1, 2)) in by_port
    assert (22, dt.datetime(2024, 1, 2, 12, 30, 0, 1), dt.date(2024, 1, 2)) in by_port
    assert (None, dt.datetime(2024, 1, 2, 14, 30, 0, 500000), dt.date(2024, 1, 2)) in by_port
    garbage = [r for r in out if r.ts is None]
    assert len(garbage) == 1 and garbage[0].day is None and garbage[0].Dport is None
    assert dict(prepare_flows(raw_rows(spark, rows), "147.32.8").dtypes)["ts"] == "timestamp_ntz"


def test_attacker_thresholds(spark):
    rows = []
    for i in range(4):  # 4 hosts, 1 port: not an attacker
        rows.append(_flow("10.0.0.4", f"147.32.80.{i}", "22"))
    for i in range(5):  # 5 hosts: attacker
        rows.append(_flow("10.0.0.5", f"147.32.80.{i}", "22"))
    for p in ("22", "23"):  # 2 ports: no
        rows.append(_flow("10.0.0.2", "147.32.80.1", p))
    for p in ("22", "23", "25"):  # 3 ports: yes
        rows.append(_flow("10.0.0.3", "147.32.80.1", p))
    rows.append(_flow("10.0.0.6", "147.32.80.1", "22"))  # NULL ports do not count
    rows.append(_flow("10.0.0.6", "147.32.80.1", "na"))
    rows.append(_flow("10.0.0.6", "147.32.80.1", "x"))
    flows = prepare_flows(raw_rows(spark, rows), "147.32.8")
    got = sorted(r.SrcAddr for r in daily_attackers(flows).collect())
    assert got == ["10.0.0.3", "10.0.0.5"]
    assert attacker_flows(flows).count() == 8


def _strategy_records(spark, date, probs, rat=0.5, hp=1.0):
    stg = [(p, v) for p, v in probs.items()]
    return spark.createDataFrame(
        [(date, rat, hp, None, None, stg)],
        "date string, rationality double, num_of_hp double, reward double, used_hps double, "
        "stg array<struct<port:int,prob:double>>")


def test_strategy_dates_and_ids(spark):
    a = _strategy_records(spark, "2016-09-29 00:00:00.0", {22: 0.5})
    b = _strategy_records(spark, "2018-09-18:10.0.0", {80: 0.25}, rat=0.30000000000000004, hp=2.0)
    long = strategy_long(a.unionByName(b)).orderBy("port").collect()
    assert [r.application_date for r in long] == [dt.date(2016, 9, 30), dt.date(2018, 9, 19)]
    assert long[0].strategy_id == "2016-09-29 00:00:00.0_1.0_0.5"
    assert strategy_long(a.unionByName(b), rationality=0.3, num_of_hp=2).count() == 1


def test_detection_ties_and_saved_strictly_after(spark):
    # One attacker (3 ports) on 2024-01-02; an unused flow on port 22 at 10:00 is the detection
    # (prob 1). Open flows: one at the same instant (not saved), one later (saved).
    t0, t1 = "2024/01/02 10:00:00.000000", "2024/01/02 11:00:00.000000"
    rows = [
        _flow("10.0.0.1", "147.32.80.1", "22", "S_RA", t0),
        _flow("10.0.0.1", "147.32.80.2", "23", "S_SA", t0),
        _flow("10.0.0.1", "147.32.80.3", "25", "S_SA", t1),
    ]
    flows = prepare_flows(raw_rows(spark, rows), "147.32.8", drop_null_port=True)
    att = attacker_flows(flows)
    strat = strategy_long(_strategy_records(spark, "2024-01-01", {22: 1.0}))
    det = first_detection(honeypot_assignment(att, strat)).collect()
    assert len(det) == 1 and det[0].detection_time == dt.datetime(2024, 1, 2, 10, 0)
    saved = saved_flows(att, first_detection(honeypot_assignment(att, strat))).collect()
    assert [(r.saved, r.total_attacks, r.saved_ratio) for r in saved] == [(1, 2, 0.5)]
    summary = strategy_setup_summary(saved_flows(att, first_detection(honeypot_assignment(att, strat))), strat)
    row = summary.collect()[0]
    assert row.avg_saved_ratio == 0.5 and row.stddev is None  # one day: sample stddev is NULL


def test_ratio_mode_places_when_share_small(spark):
    # 5 hosts probed on port 22 with unused flows: ratio = (5 + 1) / 5 > 1 >= prob, so placement
    # depends on the roll; with prob 0 nothing is ever placed.
    rows = [_flow("10.0.0.1", f"147.32.80.{i}", "22", "S_RA", f"2024/01/02 10:00:0{i}.000000") for i in range(5)]
    att = attacker_flows(prepare_flows(raw_rows(spark, rows), "147.32.8"))
    strat0 = strategy_long(_strategy_records(spark, "2024-01-01", {22: 0.0}))
    got = honeypot_assignment(att, strat0, mode="ratio").collect()
    assert len(got) == 5 and not any(r.is_hp for r in got)
    assert all(r.ratio == pytest.approx(6 / 5) for r in got)


def test_optional_whole_row_dedupe(spark):
    rows = [_flow("10.0.0.1", "147.32.80.1", "22")] * 3 + [_flow("10.0.0.1", "147.32.80.2", "22")]
    raw = raw_rows(spark, rows)
    assert prepare_flows(raw, "147.32.8").count() == 4
    assert prepare_flows(raw, "147.32.8", dedupe=True).count() == 2


def test_ratio_placement_by_hand(spark):
    from flowlure.functions import place_by_ratio

    # ratio, prob, roll -> honeypot; scaled chance prob / ratio in the comment
    cases = [
        (0.2, 0.5, 0.99, True),    # few candidates: always
        (0.5, 0.5, 0.99, True),    # as many as the share
        (1.0, 0.5, 0.49, True),    # 0.5
        (1.0, 0.5, 0.5, False),    # 0.5, not below
        (0.8, 0.2, 0.24, True),    # 0.25
        (0.8, 0.2, 0.26, False),   # 0.25
        (1.5, 0.75, 0.6, False),   # 0.5: shares above one are possible
        (0.4, 0.0, 0.0, False),    # never
        (0.0, 0.0, 0.9, True),     # no host at all: the share is reached
    ]
    df = spark.createDataFrame(cases, "ratio double, prob double, roll double, want boolean")
    assert df.where(place_by_ratio() != F.col("want")).count() == 0


def test_times_do_not_pass_through_the_session_zone(spark):
    """Nights when clocks change: times, days, rolls and counts are the same in every zone."""
    from flowlure.functions import flow_roll
    from flowlure.operators.timeline import count_after

    times = [f"{day} {time}" for day in ("2017/03/26", "2017/10/29") for time in ("01:59:59.9", "02:00:00", "02:30:00.000001", "03:10:00", "03:30:00")]
    raw = raw_rows(spark, [("tcp", "10.0.0.1", "147.32.80.1", "22", "S_", t) for t in times])
    before, seen = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "Europe/Prague", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            flows = prepare_flows(raw, "147.32.8")
            later = count_after(flows.withColumn("id", F.col("ts").cast("string")), flows, ["SrcAddr", "day"], ["SrcAddr", "day", "id"])
            seen.append((sorted(tuple(r) for r in flows.select(F.col("ts").cast("string"), "day", flow_roll("x")).collect()),
                         sorted(tuple(r) for r in later.collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == seen[1] == seen[2]
    assert [r[3] for r in seen[0][1]] == [4, 3, 2, 1] * 2


def test_malformed_times_are_null(spark):
    bad = ["2017-03-26 01:00:00", "2017/3/26 01:00:00", "2017/03/26 1:00:00", "2017/03/26T01:00:00", "2017/03/26 25:00:00",
           "2017/02/30 01:00:00", "2017/03/26 01:00:00.1234567", "2017/03/26 01:00:00Z", "", None]
    rows = prepare_flows(raw_rows(spark, [("tcp", "10.0.0.1", "147.32.80.1", "22", "S_", t) for t in bad]), "147.32.8")
    assert rows.where("ts IS NOT NULL").count() == 0


def test_pair_comparison_has_every_input_day(spark):
    from flowlure.operators import strategy_pair_comparison

    unused = [("tcp", "10.0.0.1", f"147.32.80.{h}", "22", "S_", "2017/03/08 10:00:00") for h in range(6)]
    quiet = [("tcp", "10.0.0.2", "147.32.80.1", "22", "S_", "2017/03/09 10:00:00")]
    got = strategy_pair_comparison(prepare_flows(raw_rows(spark, unused + quiet), "147.32.8"), rate=1.0).orderBy("day").collect()
    assert [(str(r.day), r.saved_a, r.saved_b) for r in got] == [("2017-03-08", 0, 0), ("2017-03-09", 0, 0)]


def test_zero_days_enter_means_on_request(spark):
    from flowlure.operators import average_attackers_per_port, port_hit_summary, strategy_setup_summary

    flows = prepare_flows(raw_rows(spark, [("tcp", f"10.0.0.{s}", f"147.32.80.{h}", str(p), "S_", f"2017/03/{d:02d} 10:00:00")
                                           for d, p, n in ((8, 22, 2), (8, 80, 1), (9, 22, 1)) for s in range(n) for h in range(5)]), "147.32.8")
    mean = lambda zero: {r.Dport: r.average_count for r in average_attackers_per_port(flows, include_zero_days=zero).collect()}
    assert mean(False) == {22: 1.5, 80: 1.0} and mean(True) == {22: 1.5, 80: 0.5}
    saved = spark.createDataFrame([("a", "2017-03-08", 0.5)], "strategy_id string, day string, saved_ratio double").withColumn("day", F.col("day").cast("date"))
    strategies = spark.createDataFrame([("a", "2017-03-08", 0.1, 1.0), ("b", "2017-03-09", 0.1, 1.0), ("c", "2017-03-10", 0.1, 1.0)],
                                       "strategy_id string, application_date string, rationality double, num_of_hp double").withColumn("application_date", F.col("application_date").cast("date"))
    days = flows.select("day").distinct()
    assert [r.avg_saved_ratio for r in strategy_setup_summary(saved, strategies).collect()] == [0.5]
    assert [r.avg_saved_ratio for r in strategy_setup_summary(saved, strategies, zero_days=days).collect()] == [0.25]
    hits = spark.createDataFrame([("s", "a", 1, 10, 22, True), ("t", "a", 1, 10, 22, True), ("s", "b", 2, 10, 22, False), ("s", "c", 3, 10, 80, True)],
                                 "SrcAddr string, strategy_id string, day int, ts int, Dport int, is_hp boolean")
    told = {r.Dport: (r.avg_hit, r.stddev) for r in port_hit_summary(hits, include_zero_days=True).collect()}
    assert told[22][0] == 2 / 3 and abs(told[22][1] - (4 / 3) ** 0.5) < 1e-9 and told[80][0] == 1 / 3
