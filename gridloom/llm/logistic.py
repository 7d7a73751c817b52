"""Small models fitted on the driver from bounded samples: logistic regression and positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Linear:
    """Scores sigmoid(w . (x - mean) / scale + b); x has its values bounded first, so no text can overflow it."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.asarray(x, float).reshape(-1, len(self.mean)) - self.mean) / self.scale, -8, 8) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    return mean, scale, np.clip((x - mean) / scale, -8, 8)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Linear:
    """Ridge logistic regression by Newton steps. Without rows, or of one class, a constant score comes back."""
    x = np.asarray(x, float)
    if not len(y) or y.min() == y.max():
        k = x.shape[1]
        return Linear(np.zeros(k), np.ones(k), np.zeros(k), -2.0 if not len(y) or y[0] == 0 else 2.0)
    mean, scale, z = _scaled(x)
    z = np.hstack([z, np.ones((len(z), 1))])
    w, pen = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (y - p) - pen * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled, by scores: the smallest ratio P_unl(s <= t) / P_pos(s <= t) or
    P_unl(s >= t) / P_pos(s >= t), each with its sampling error added, over thresholds t with enough positives."""
    best = 1.0
    for sign in (1, -1):
        p, u = np.sort(sign * pos), np.sort(sign * unl)
        for t in np.quantile(p, np.linspace(0.02, 0.98, 97)):
            fp, fu = (p >= t).mean(), (u >= t).mean()
            if fp >= 0.05:
                best = min(best, (fu + 1.5 * np.sqrt(fu * (1 - fu) / len(u))) / max(fp - 1.5 * np.sqrt(fp * (1 - fp) / len(p)), 1e-3))
    return float(min(max(best, 0.01), 0.99))


def binned_prior(pos: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> float:
    """class_prior() with the unlabelled as counts between ascending edges: counts[i] have a score of edges[i] or more, but less than the next."""
    n = counts.sum()
    if not n or not len(pos):
        return 1.0
    best, above = 1.0, counts[::-1].cumsum()[::-1] / n
    error = lambda f, k: 1.5 * np.sqrt(f * (1 - f) / k)
    for edge, up in zip(edges, above, strict=True):
        share = float((pos >= edge).mean())
        for fp, fu in ((share, up), (1 - share, 1 - up)):
            if fp >= 0.05:
                best = min(best, (fu + error(fu, n)) / max(fp - error(fp, len(pos)), 1e-3))
    return float(min(max(best, 0.01), 0.99))


def slopes(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What rows z add to the risk of label 0 at w: their number, summed loss and summed gradient."""
    m = z @ w
    return np.r_[len(z), np.logaddexp(0, m).sum(), z.T @ sigmoid(m)]


def curvature(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """slopes(), and the upper half of the second derivative."""
    p = sigmoid(z @ w)
    h = (z * (p * (1 - p))[:, None]).T @ z
    return np.r_[slopes(z, w), h[np.triu_indices(len(w))]]


def fit_two(sums, mean: np.ndarray, scale: np.ndarray, pos: np.ndarray, steps: int = 40) -> Linear:
    """Logistic regression of positives against all unlabelled, both with the same weight, by Newton steps that are halved until the loss falls.
    sums(w) adds curvature() up over the unlabelled, wherever they are: one call a trial."""
    zp, ridge = standard(pos, mean, scale), 0.5 / len(pos)  # as fit_logistic()'s ridge of 1 on sums
    k = zp.shape[1]
    upper, pen = np.triu_indices(k), np.r_[np.full(k - 1, 2 * ridge), 1e-9]

    def at(w):
        s, p = sums(w), sigmoid(zp @ w)
        h = np.zeros((k, k))
        h[upper] = s[2 + k :]
        bend = (zp * (p * (1 - p))[:, None]).T @ zp / len(zp) + (h + np.triu(h, 1).T) / s[0] + np.diag(pen + 1e-9)
        return np.logaddexp(0, -zp @ w).mean() + s[1] / s[0] + 0.5 * pen @ (w * w), zp.T @ (p - 1) / len(zp) + s[2 : 2 + k] / s[0] + pen * w, bend

    w = np.zeros(k)
    now = at(w)
    for _ in range(steps):
        step = np.linalg.solve(now[2], now[1])
        gain = now[1] @ step
        if gain < 1e-6:
            break
        size = min(1.0, 5 / np.abs(step).max())
        while (trial := at(w - size * step))[0] > now[0] - 1e-4 * size * gain and size > 1e-6:
            size /= 2
        w, now = w - size * step, trial
    return Linear(mean, scale, w[:-1], float(w[-1]))


def fit_non_negative(sums, mean: np.ndarray, scale: np.ndarray, pos: np.ndarray, prior: float, steps: int = 40, rate: float = 0.1, ridge: float = 3e-3) -> Linear:
    """Non-negative positive-unlabelled risk, logistic loss, full-batch Adam. sums(w) adds slopes() up over the unlabelled: one call a step.

    Risk: prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)); where the bracket falls below zero the step
    goes up its gradient instead, so the flexible model can't push it under. The step of least risk is the model.
    """
    zp = standard(pos, mean, scale)
    w, m, v = (np.zeros(zp.shape[1]) for _ in range(3))
    best, best_risk = w, np.inf
    for t in range(1, steps + 1):
        s, mp = sums(w), zp @ w
        negative = s[1] / s[0] - prior * np.logaddexp(0, mp).mean()
        risk = prior * np.logaddexp(0, -mp).mean() + max(0.0, negative)
        if risk < best_risk:
            best, best_risk = w.copy(), risk
        up = s[2:] / s[0] - prior * (zp.T @ sigmoid(mp)) / len(zp)
        g = -up if negative < 0 else -prior * (zp.T @ sigmoid(-mp)) / len(zp) + up
        g = g + 2 * ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(mean, scale, best[:-1], float(best[-1]))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows as a model sees them, with a last column of ones."""
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def constant(k: int, b: float) -> Linear:
    return Linear(np.zeros(k), np.ones(k), np.zeros(k), b)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> tuple[Linear, float]:
    """(model, class prior) of the non-negative risk for arrays; see fit_non_negative()."""
    if not len(pos) or not len(unl):
        return constant((pos if len(pos) else unl).shape[1], 2.0), 1.0
    mean, scale, _ = _scaled(unl)
    z = standard(unl, mean, scale)
    if prior is None:
        first = fit_two(lambda w: curvature(z, w), mean, scale, pos)
        prior = class_prior(first.margin(pos), first.margin(unl))
    return fit_non_negative(lambda w: slopes(z, w), mean, scale, pos, prior), prior
