"""The allocation game as Spark jobs: top ports, grid, sweep, scoring."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_allocation_golden import EXPECTED, _inputs
from flowlure.operators import strategy_parameter_grid, strategy_scoring, strategy_sweep, top_attacked_ports
from flowlure.operators.game import grid_values

DAY = dt.date(2016, 9, 29)


@pytest.fixture(scope="module")
def golden_stats(spark):
    p, s = _inputs()
    rows = [(DAY, 1000 + i, float(p[i]), float(s[i])) for i in range(len(p))]
    rows.append((DAY, 9, 0.0, 0.5))  # never attacked: ranks last and falls outside the top 25
    return spark.createDataFrame(rows, "day date, port int, attack_probability double, open_port_probability double")


def test_grid_values_are_rounded():
    g = grid_values(1.0, 0.1)
    assert len(g) == 11 and g[3] == 0.3 and g[-1] == 1.0
    assert grid_values(7.0, 1.0) == [float(i) for i in range(8)]


def test_top_ports_keeps_25(golden_stats):
    top = top_attacked_ports(golden_stats)
    assert top.count() == 25 and top.where(F.col("port") == 9).count() == 0


def test_sweep_matches_golden(spark, golden_stats):
    sweep = strategy_sweep(top_attacked_ports(golden_stats), rationalities=[0.0, 0.5, 1.0],
                           honeypots=[0.0, 1.0, 2.0], partitions=4)
    res = {(r.rationality, r.num_of_hp): (r.reward, r.feasible, r.used_hps)
           for r in sweep.select("rationality", "num_of_hp", "reward", "feasible", "used_hps").distinct().collect()}
    for key, reward in EXPECTED.items():
        assert res[key][0] == pytest.approx(reward, abs=1e-8), key
        assert res[key][1]
    for rat in (0.0, 0.5, 1.0):
        assert res[(rat, 0.0)] == (0.0, False, 0.0)


def test_scoring_agrees_with_sweep(spark, golden_stats):
    sweep = strategy_sweep(top_attacked_ports(golden_stats), rationalities=[0.2, 0.9], honeypots=[1.0, 3.0],
                           partitions=2)
    as_strategies = sweep.select(
        F.concat_ws("_", F.col("day").cast("string"), F.col("num_of_hp").cast("string"),
                    F.col("rationality").cast("string")).alias("strategy_id"),
        F.date_add("day", 1).alias("application_date"), "rationality", "num_of_hp", "port", "prob")
    scored = strategy_scoring(as_strategies, golden_stats)
    got = {(r.rationality, r.num_of_hp): (r.reward, r.feasible) for r in scored.collect()}
    want = {(r.rationality, r.num_of_hp): r.reward for r in sweep.select("rationality", "num_of_hp", "reward").distinct().collect()}
    assert set(got) == set(want)
    for key, reward in want.items():
        assert got[key][0] == pytest.approx(reward, rel=1e-9)
        assert got[key][1]


def test_parameter_grid(spark, golden_stats):
    grid = strategy_parameter_grid(golden_stats)
    assert grid.count() == 11 * 8
    assert grid.where((F.col("rationality") == 0.3) & (F.col("num_of_hp") == 7.0)).count() == 1
