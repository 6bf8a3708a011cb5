"""Brute-force checks of the allocation solver (the sweep has no SQL statement)."""

import numpy as np
import pytest

from flowlure.operators.allocation import _fill, objective, solve_allocation


@pytest.mark.parametrize("seed", range(20))
def test_fill_matches_bisection(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 26))
    r = rng.random(n) * (rng.random(n) > 0.2)
    lo = np.full(n, 1e-4) + rng.random(n) * 0.01
    up = lo + rng.random(n) * 0.8
    budget = float(lo.sum() + rng.random() * (up.sum() - lo.sum()) * 1.2)
    h = _fill(r, lo, up, budget)
    assert np.all(h >= lo - 1e-15) and np.all(h <= up + 1e-15)
    top = np.where(r > 0, up, lo)
    if top.sum() <= budget:
        assert np.allclose(h, top)
        return
    a, b = 0.0, 1e9
    for _ in range(300):
        m = 0.5 * (a + b)
        a, b = (m, b) if np.clip(m * r, lo, up).sum() < budget else (a, m)
    assert h.sum() == pytest.approx(budget, rel=1e-12)
    assert np.allclose(h, np.clip(b * r, lo, up), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("seed", range(12))
def test_optimum_beats_random_feasible_allocations(seed):
    rng = np.random.default_rng(100 + seed)
    n = int(rng.integers(3, 12))
    p = rng.random(n)
    p /= p.sum()
    s = rng.random(n) * 0.6
    budget = float(rng.choice([1.0, 2.0, 3.0]))
    rat = float(rng.choice([0.0, 0.3, 0.7, 1.0]))
    h, reward, used, feasible = solve_allocation(p, s, budget, rat)
    assert feasible and used <= budget + 1e-9
    lo, up = 1e-4, 1 - s
    for _ in range(4000):
        x = lo + rng.random(n) * (up - lo)
        if x.sum() > budget:
            x = lo + (x - lo) * (budget - n * lo) / (x.sum() - n * lo)
        assert objective(p, s, x, rat) >= reward - 1e-9
