"""Proofs of optimality of the allocation: they hold for the solver's answers and for no worse ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from flowlure.operators import strategy_sweep, sweep_certificate, top_attacked_ports
from flowlure.operators.allocation import certificate, lower_bound, objective, solve_allocation
from flowlure.plans import catalog
from flowlure.plans.persist import materialize


def groups(seed, n):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        k = rng.integers(1, 26)
        s = np.round(rng.random(k) * rng.choice([0.1, 0.5, 1.0]), 3) * (rng.random(k) > rng.choice([0, 0.3]))
        p = np.round(rng.random(k), 2) * (rng.random(k) > rng.choice([0, 0.2]))
        yield p, s, float(rng.choice([0.001, 0.01, 0.3, 1, 2, 5, 7, 30])), float(rng.choice([0, 0.1, 0.5, 0.9, 1.0]))


def test_the_solver_is_proven_optimal():
    seen = 0
    for p, s, budget, rat in groups(1, 1500):
        h, reward, used, feasible = solve_allocation(p, s, budget, rat)
        if not feasible:
            continue
        seen += 1
        assert used <= budget + 1e-9 and (h >= 1e-4 * (1 - 1e-9)).all() and (h <= 1 - s + 1e-12).all()
        multiplier, weights = certificate(p, s, h, budget, rat)
        bound = lower_bound(p, s, budget, rat, 1e-4, multiplier, weights)
        assert multiplier >= 0 and (weights >= 0).all() and (not s.any() or abs(weights.sum() - rat) < 1e-9)
        assert -1e-9 * max(1, reward) <= reward - bound <= 1e-9 * max(1, reward), (p, s, budget, rat)
    assert seen > 700


def test_no_multiplier_proves_too_much():
    """Weak duality: whatever the multiplier and weights, no allowed allocation is below the bound."""
    rng = np.random.default_rng(2)
    for p, s, budget, rat in groups(3, 300):
        up = 1 - s
        if budget < len(p) * 1e-4 or (up < 1e-4).any():
            continue
        weights = rng.random(len(p))
        weights *= rat / weights.sum()
        bound = lower_bound(p, s, budget, rat, 1e-4, float(rng.choice([0, 1e-3, 1, 100])), weights)
        for _ in range(20):
            h = np.clip(rng.random(len(p)) * up, 1e-4, up)
            h = 1e-4 + (h - 1e-4) * min(1.0, max(0.0, budget - len(p) * 1e-4) / max((h - 1e-4).sum(), 1e-12))
            assert objective(p, s, h, rat) >= bound - 1e-9 * max(1, abs(bound))


def test_budgets_near_the_least():
    """Eight ports at a budget of a quarter more than the least: shares stay within the budget."""
    s = np.array([0.03, 0.06, 0.01, 0.05, 0.02, 0.04, 0.06, 0.01])
    h, _, used, feasible = solve_allocation(np.full(8, 0.5), s, 0.001, 1.0)
    assert feasible and used <= 0.001 + 1e-12 and np.isclose(np.max(s / h), np.max(s / np.maximum(1e-4, s * np.min(h / s))))


@pytest.fixture(scope="module")
def top(spark):
    return materialize(top_attacked_ports(catalog.scattered_stats(spark, SF_CHECK)).where(F.col("day") <= dt.date(2024, 1, 4)), "top")


@pytest.mark.parametrize("change,certified", [
    ({}, True),
    ({"prob": "prob * 0.97D"}, False),  # budget left over
    ({"prob": "prob * 1.2D"}, False),  # beyond the budget
    ({"weight": "weight * 0.5D"}, False),  # weights that do not sum to rat
    ({"multiplier": "multiplier * 1.1D"}, False),
    ({"prob": "if(port % 2 = 0, prob * 0.9D, prob)"}, False),
])
def test_only_the_optimum_is_certified(spark, top, change, certified):
    sweep = strategy_sweep(top, rationalities=[0.5], honeypots=[1.0, 2.0]).withColumns({k: F.expr(v) for k, v in change.items()})
    found = sweep_certificate(sweep, top).collect()
    assert len(found) == 8 and {r["feasible"] for r in found} == {True}
    assert {r["certified"] for r in found} == {certified}, found


def test_infeasible_points_are_not_certified(spark, top):
    found = sweep_certificate(strategy_sweep(top, rationalities=[0.0], honeypots=[0.0]), top).collect()
    assert {(r["feasible"], r["certified"], r["reward"]) for r in found} == {(False, False, 0.0)}
