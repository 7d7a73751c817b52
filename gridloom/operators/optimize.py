"""Box-bounded minimisers for a handful of parameters whose cost is a Spark job.

A cost takes a list of parameter vectors and gives a number each, so that a whole gradient, or all steps of a line search,
is one job. Parameters are worked on in units of their bounds' range, which makes shifts, angles and scales comparable.
Runs are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Costs = Callable[[list[np.ndarray]], Sequence[float]]
#: Steps of a line search, in units of the direction.
STEPS = [2.0**k for k in range(-6, 4)]


def estimate_change(costs: Costs, x: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """The cost with each parameter moved by its tolerance; NaN where the tolerance is 0."""
    free = np.flatnonzero(tolerance)
    out = np.full(len(x), np.nan)
    if len(free):
        moved = [x + np.eye(len(x))[i] * tolerance[i] for i in free]
        out[free] = costs(moved)
    return out


def gradient(costs: Costs, x: np.ndarray, value: float, tolerance: np.ndarray) -> np.ndarray:
    """Forward differences, 0 for parameters without tolerance."""
    change = estimate_change(costs, x, tolerance) - value
    return np.where(tolerance != 0, change / np.where(tolerance != 0, tolerance, 1.0), 0.0)


def line_search(costs: Costs, x: np.ndarray, value: float, direction: np.ndarray, low: np.ndarray, high: np.ndarray, steps: Sequence[float] = tuple(STEPS)) -> tuple[np.ndarray, float] | None:
    """The best of all steps against the direction, clamped to the bounds; None if none is better."""
    points = [np.clip(x - s * direction, low, high) for s in steps]
    found = np.asarray(costs(points), float)
    k = int(np.nanargmin(found)) if not np.isnan(found).all() else 0
    return (points[k], float(found[k])) if found[k] < value else None


def gradient_descent(costs: Costs, x, low, high, precision: float = 0.001, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Steepest descent with the line search above."""
    x, low, high = (np.asarray(v, float) for v in (x, low, high))
    tolerance = (high - low) * precision
    value = float(costs([x])[0])
    for _ in range(rounds):
        g = gradient(costs, x, value, tolerance) * tolerance
        size = np.linalg.norm(g)
        if not size:
            break
        better = line_search(costs, x, value, g * (np.linalg.norm(tolerance) / size) * np.where(tolerance > 0, tolerance / (tolerance.max() or 1), 0), low, high)
        if better is None:
            break
        x, value = better
    return x, value


def lbfgs(costs: Costs, x, low, high, precision: float = 0.001, rounds: int = 100, memory: int = 10) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent: (parameters, cost). Two jobs a round.

    Curvature pairs that don't point downhill are left out; where no step helps, the memory is emptied once before the end.
    Parameters whose bounds meet stay.
    """
    x, low, high = (np.asarray(v, float) for v in (x, low, high))
    span = high - low
    free = span > 0
    if not free.any():
        return x, float(costs([x])[0])
    real = lambda us: [np.where(free, low + u * span, x) for u in us]
    inner: Costs = lambda us: costs(real(us))
    u = np.where(free, (np.clip(x, low, high) - low) / np.where(free, span, 1.0), 0.0)
    zeros, ones, tolerance = np.zeros(len(x)), np.ones(len(x)), np.where(free, precision, 0.0)
    value = float(inner([u])[0])
    g = gradient(inner, u, value, tolerance)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        elif (size := np.linalg.norm(q)) > 0:
            q = q * (precision * np.sqrt(free.sum()) / size)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        better = line_search(inner, u, value, q, zeros, ones)
        if better is None:
            if not pairs:
                break
            pairs = []
            continue
        moved, value = better
        new = gradient(inner, moved, value, tolerance)
        s, y = moved - u, new - g
        u, g = moved, new
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y)][-memory:]
    return real([u])[0], value
