"""Golden sweep: inputs recovered from a published one-day sweep predict its other rewards."""

import numpy as np
import pytest

from flowlure.operators.allocation import objective, solve_allocation

# One published sweep day (25 ports, same port order in both lists).
# Honeypot shares at rationality 1, budget 1 (reward 2.125244618395303) ...
H_RAT1_HP1 = [
    0.0009208103130755066, 0.01104972375690608, 0.032228360957642734, 0.0009208103130755067,
    0.31123388581952127, 0.0009208103130755066, 0.00552486187845304, 0.0009208103130755067,
    0.0018416206261506003, 0.06721915285451198, 0.1372007366482505, 0.07826887661141807,
    0.0009208103130755067, 0.011970534069981588, 0.00828729281767956, 0.0009208103130755066,
    0.0009208103130755066, 0.0009208103130755067, 0.24861878453038683, 0.013812154696132601,
    0.0405156537753223, 0.010128913443830575, 0.006445672191528547, 0.0018416206261510132,
    0.006445672191528547,
]
REWARD_RAT1_HP1 = 2.125244618395303
# ... and at rationality 0, budget 1 (reward 0.15228143279250175).
H_RAT0_HP1 = [
    0.002062185740121912, 0.010665708475057115, 0.018129847413797747, 0.0018105398294408722,
    0.12845214238611272, 0.0021256526075477287, 0.19113916666246525, 0.005189720533918746,
    0.00525756316790567, 0.06044951973551582, 0.11080052262116297, 0.19591784159926828,
    0.004953898467504152, 0.006349111009160119, 0.0059231789745772855, 0.0018348436678470167,
    0.006034316345735419, 0.0040044833578418, 0.17285036576618334, 0.00831293827539539,
    0.03645950297060533, 0.00789757153875738, 0.005512572123258322, 0.0025256518939769613,
    0.005341154836842584,
]
REWARD_RAT0_HP1 = 0.15228143279250175
# Published rewards at the other grid points: (rationality, budget) -> reward.
EXPECTED = {
    (0.0, 2.0): 0.07614071639625111,
    (0.5, 1.0): 1.249494517524998,
    (0.5, 2.0): 1.0154016913543369,
    (1.0, 2.0): 1.9537572254335258,
    (0.0, 1.0): REWARD_RAT0_HP1,
    (1.0, 1.0): REWARD_RAT1_HP1,
}


def _inputs():
    s = REWARD_RAT1_HP1 * np.array(H_RAT1_HP1)
    h0 = np.array(H_RAT0_HP1)
    p = h0 ** 2 * REWARD_RAT0_HP1 / s
    return p, s


@pytest.mark.parametrize("rat,budget", sorted(EXPECTED))
def test_golden_rewards(rat, budget):
    p, s = _inputs()
    h, reward, used, feasible = solve_allocation(p, s, budget, rat)
    assert feasible
    assert reward == pytest.approx(EXPECTED[(rat, budget)], abs=1e-8)
    assert objective(p, s, h, rat) == pytest.approx(reward, abs=1e-12)
    assert used <= budget + 1e-9
    assert np.all(h >= 1e-4 - 1e-15) and np.all(h <= 1 - s + 1e-12)


def test_shares_unique_where_published_optimum_is():
    p, s = _inputs()
    h, *_ = solve_allocation(p, s, 1.0, 0.0)
    assert np.allclose(h, H_RAT0_HP1, atol=1e-9)


def test_zero_budget_is_infeasible():
    p, s = _inputs()
    h, reward, used, feasible = solve_allocation(p, s, 0.0, 0.5)
    assert not feasible and reward == 0.0 and used == 0.0 and np.all(h == 0)


def test_full_production_port_is_infeasible():
    h, reward, used, feasible = solve_allocation([0.5, 0.5], [1.0, 0.2], 1.0, 0.5)
    assert not feasible


def test_budget_above_caps_uses_caps():
    p, s = np.array([0.2, 0.3]), np.array([0.5, 0.6])
    h, reward, used, feasible = solve_allocation(p, s, 5.0, 0.3)
    assert feasible and np.allclose(h, 1 - s)


def test_unattacked_ports_only():
    # No port is attacked: nothing to weigh, shares stay at their lower bounds.
    h, reward, used, feasible = solve_allocation([0.0, 0.0, 0.0], [0.2, 0.1, 0.0], 1.0, 0.5)
    assert feasible and np.all(h >= 1e-4) and used <= 1.0 + 1e-12
    h, reward, used, feasible = solve_allocation([0.0, 0.0], [0.2, 0.1], 1.0, 0.0)
    assert feasible and reward == 0.0
