"""Honeypot allocation for one (day, rationality, budget) group: a small convex program.

    minimise  rat * max_i s_i/h_i + (1 - rat) * sum_j p_j s_j / h_j
    over h    with  hmin <= h_j <= 1 - s_j  and  sum_j h_j <= L

(``s`` production share, ``p`` attack share of a port). With tau = 1/t and the epigraph
``h_j >= s_j * tau`` the program is jointly convex in (h, tau), so

* for fixed tau the best h is ``clip(k * sqrt(p s), max(hmin, s tau), 1 - s)`` with k set
  so the budget binds (solved exactly: the sum is piecewise linear in k), and
* the optimal value as a function of tau is convex: a golden-section search finds it.

Plain numpy on at most a few dozen ports; Spark runs one group per task call.
"""

from __future__ import annotations

import numpy as np

GOLDEN_ITERATIONS = 200
_INV_PHI = (np.sqrt(5.0) - 1.0) / 2.0


def _fill(r: np.ndarray, lo: np.ndarray, up: np.ndarray, budget: float) -> np.ndarray:
    """h = clip(k r, lo, up) with sum(h) = budget, or all at ``up`` when they fit.

    sum(h) is piecewise linear in k: port j starts rising at lo_j / r_j (slope + r_j) and
    stops at up_j / r_j (slope - r_j). Sorting those breakpoints gives the sum at each of
    them by accumulating slopes; k follows exactly from the segment that holds the budget.
    """
    pos = r > 0
    top = np.where(pos, up, lo)
    if top.sum() <= budget or not pos.any():
        return top
    rp = r[pos]
    bps = np.concatenate([lo[pos] / rp, up[pos] / rp])
    order = np.argsort(bps, kind="stable")
    bps = bps[order]
    slopes = np.cumsum(np.concatenate([rp, -rp])[order])
    sums = lo.sum() + np.concatenate([[0.0], np.cumsum(slopes[:-1] * np.diff(bps))])
    idx = int(np.searchsorted(sums, budget))
    if idx >= len(bps):
        return top
    if idx == 0:
        k = bps[0]
    else:
        slope = slopes[idx - 1]
        k = bps[idx] if slope <= 0 else bps[idx - 1] + (budget - sums[idx - 1]) / slope
    return np.clip(k * r, lo, up)


def _max_tau(s: np.ndarray, up: np.ndarray, hmin: float, budget: float) -> float:
    """Largest tau with max(hmin, s tau) <= up for all ports and sum max(hmin, s tau) <= budget."""
    pos = s > 0
    if not pos.any():
        return np.inf
    cap = float(np.min(up[pos] / s[pos]))
    rising = np.sort(s[pos])[::-1]  # a port's lower bound rises from tau = hmin / s on, the largest s first
    bps = hmin / rising
    slopes = np.cumsum(rising)
    sums = len(s) * hmin + np.concatenate([[0.0], np.cumsum(slopes[:-1] * np.diff(bps))])
    idx = int(np.searchsorted(sums, budget, side="right"))
    tau = bps[0] if idx == 0 else bps[idx - 1] + (budget - sums[idx - 1]) / slopes[idx - 1]
    return min(cap, float(tau))


def objective(p, s, h, rat) -> float:
    """rat * max(s/h) + (1 - rat) * sum(p s / h)."""
    p, s, h = (np.asarray(x, dtype=float) for x in (p, s, h))
    return float(rat * np.max(s / h) + (1.0 - rat) * np.sum(p * s / h))


def lower_bound(p, s, budget: float, rat: float, hmin: float, multiplier: float, weights: np.ndarray) -> float:
    """What no allocation can fall below, by weak duality, for any ``multiplier`` and ``weights``.

    ``multiplier`` >= 0 prices the budget; ``weights`` >= 0 with sum ``rat`` replace the maximum
    of s/h by their weighted sum, which is never more. Each port is then on its own.
    """
    a = weights * s + (1.0 - rat) * p * s
    up = 1.0 - s
    best = np.sqrt(a / multiplier) if multiplier > 0 else np.where(a > 0, up, hmin)
    h = np.clip(best, hmin, up)
    return float(np.sum(a / h) + multiplier * (h.sum() - budget))


def certificate(p, s, h, budget: float, rat: float, hmin: float = 1e-4) -> tuple[float, np.ndarray]:
    """(multiplier of the budget, weight per port) that prove ``h`` optimal: see ``lower_bound``.

    At an optimum the ports where s/h is greatest carry all the weight, and a port strictly
    inside its bounds has (weight * s + (1 - rat) * p * s) / h**2 equal to the multiplier.
    """
    p, s, h = (np.asarray(x, dtype=float) for x in (p, s, h))
    c, up = (1.0 - rat) * p * s, 1.0 - s
    share = s / h
    top = (s > 0) & (share >= share.max() * (1 - 1e-7))
    capped, least = top & (h >= up * (1 - 1e-9)), top & (h <= hmin * (1 + 1e-9))
    inside = ~top & (c > 0) & (h > hmin * (1 + 1e-9)) & (h < up * (1 - 1e-9))
    multipliers = [0.0] if budget - h.sum() > 1e-9 or not (c.any() or rat > 0) else []
    if inside.any():
        multipliers.append(float(np.median(c[inside] / h[inside] ** 2)))
    free = top & ~capped
    if free.any():  # the weights of the free top ports alone sum to rat: piecewise linear in the multiplier
        low = np.sort(c[free] / h[free] ** 2)
        gain, base = h[free] ** 2 / s[free], c[free] / s[free]
        for m in low:
            on = c[free] / h[free] ** 2 <= m
            multipliers.append(float((rat + base[on].sum()) / gain[on].sum()))
    # Ports held at a bound leave the multiplier a range; its ends are where one of them would move.
    multipliers += [float(x) for x in (np.where(top, rat * s, 0.0) + c) / h**2]
    found = []
    for m in multipliers:
        weights = np.where(top, np.maximum((m * h**2 - c) / np.where(s > 0, s, 1.0), 0.0), 0.0)
        missing = rat - weights.sum()
        if missing > 0 and (capped if capped.any() else top).any():
            weights[np.flatnonzero(capped if capped.any() else top)[0]] += missing
        elif missing < 0:  # a port at its lower bound may carry less than what would make it move
            low = weights[least].sum()
            weights[least] *= max(0.0, 1.0 + missing / low) if low > 0 else 1.0
            weights *= rat / weights.sum() if weights.sum() > 0 else 0.0
        found.append((lower_bound(p, s, budget, rat, hmin, m, weights), m, weights))
    _, multiplier, weights = max(found, key=lambda x: x[0])
    return multiplier, weights


def solve_allocation(p, s, budget: float, rat: float, hmin: float = 1e-4):
    """Best honeypot shares ``h`` for one group.

    Returns (h, reward, used, feasible). An infeasible group (budget below ``n * hmin``,
    or a port with ``1 - s < hmin``) gives h = 0, reward 0, feasible False.
    """
    p = np.asarray(p, dtype=float)
    s = np.asarray(s, dtype=float)
    n = len(p)
    up = 1.0 - s
    if n == 0 or budget < n * hmin * (1 - 1e-12) or np.any(up < hmin):
        return np.zeros(n), 0.0, 0.0, False
    r = np.sqrt(np.maximum(p * s, 0.0))
    c = r * r
    free = _fill(r, np.full(n, hmin), up, budget)
    pos = s > 0
    if rat <= 0 or not pos.any():
        h = free
    else:
        tau_lo = float(np.min(free[pos] / s[pos]))
        tau_hi = max(tau_lo, _max_tau(s, up, hmin, budget))

        def value(tau):
            h_tau = _fill(r, np.maximum(hmin, s * tau), up, budget)
            return rat / tau + (1.0 - rat) * float(np.sum(c / h_tau)), h_tau

        a, b = tau_lo, tau_hi
        x1, x2 = b - _INV_PHI * (b - a), a + _INV_PHI * (b - a)
        f1, f2 = value(x1)[0], value(x2)[0]
        for _ in range(GOLDEN_ITERATIONS):
            if b - a <= 1e-10 * b:
                break
            if f1 <= f2:
                b, x2, f2 = x2, x1, f1
                x1 = b - _INV_PHI * (b - a)
                f1 = value(x1)[0]
            else:
                a, x1, f1 = x1, x2, f2
                x2 = a + _INV_PHI * (b - a)
                f2 = value(x2)[0]
        candidates = [value(t)[1] for t in (a, b, 0.5 * (a + b), tau_lo, tau_hi)] + [free]
        h = min(candidates, key=lambda hh: objective(p, s, hh, rat))
    return h, objective(p, s, h, rat), float(h.sum()), True
