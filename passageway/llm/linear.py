"""Linear classifiers fitted to a bounded number of sparse rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: for each entry its row, column and value."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], minlength=self.shape[1])

    def back_squares(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value**2 * v[self.row], minlength=self.shape[1])

    def take(self, chosen: np.ndarray) -> Rows:
        """The rows of a Boolean mask."""
        at = chosen[self.row]
        return Rows((np.cumsum(chosen) - 1)[self.row[at]], self.column[at], self.value[at], (int(chosen.sum()), self.shape[1]))


def _logistic(margin):
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # the chance of the wrong side
    return np.logaddexp(0, -margin), -p, p * (1 - p)


def _squared_hinge(margin):
    gap = np.maximum(0, 1 - margin)
    return gap**2, -2 * gap, 2.0 * (gap > 0)


LOSSES = {"logistic": _logistic, "hinge": _squared_hinge}


def fit(x: Rows, positive: np.ndarray, loss: str, cost: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * the sum of losses, by Newton steps with conjugate gradients.

    ``logistic`` is logistic regression, ``hinge`` the linear support vector machine with squared hinge loss.
    """
    y = np.where(positive, 1.0, -1.0)
    n, d = x.shape
    w, bias = np.zeros(d), 0.0
    ridge = 1e-6  # keeps the bias finite if all rows are of one side

    def value(w, b):
        return 0.5 * (w @ w) + 0.5 * ridge * b * b + cost * LOSSES[loss](y * (x.dot(w) + b))[0].sum()

    now = value(w, bias)
    first = None
    for _ in range(rounds):
        _, slope, curve = LOSSES[loss](y * (x.dot(w) + bias))
        pull = cost * slope * y
        gw, gb = w + x.back(pull), ridge * bias + pull.sum()
        norm = np.sqrt(gw @ gw + gb * gb)
        first = first or norm
        if norm <= 1e-3 * first:
            break
        curve = cost * np.maximum(curve, 1e-10)
        # Conjugate gradients on the Hessian, preconditioned by its diagonal.
        mw, mb = 1 + x.back_squares(curve), ridge + curve.sum()
        sw, sb = np.zeros(d), 0.0
        rw, rb = -gw, -gb
        zw, zb = rw / mw, rb / mb
        pw, pb, rz = zw, zb, rw @ zw + rb * zb
        for _ in range(40):
            v = curve * (x.dot(pw) + pb)
            hw, hb = pw + x.back(v), ridge * pb + v.sum()
            alpha = rz / max(pw @ hw + pb * hb, 1e-300)
            sw, sb = sw + alpha * pw, sb + alpha * pb
            rw, rb = rw - alpha * hw, rb - alpha * hb
            if np.sqrt(rw @ rw + rb * rb) <= 0.1 * norm:
                break
            zw, zb = rw / mw, rb / mb
            new = rw @ zw + rb * zb
            pw, pb, rz = zw + new / rz * pw, zb + new / rz * pb, new
        step = 1.0
        gain = gw @ sw + gb * sb
        while step > 1e-6 and (then := value(w + step * sw, bias + step * sb)) > now + 0.01 * step * gain:
            step /= 2
        if step <= 1e-6:
            break
        w, bias, now = w + step * sw, bias + step * sb, then
    return w, float(bias)


def descend(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, tolerance: float = 1e-3, rounds: int = 100, memory: int = 10) -> np.ndarray:
    """The minimum of a convex ``cost``, which returns its value and gradient, by limited-memory quasi-Newton steps.

    Ends when the gradient is ``tolerance`` of the first one. Each step asks for one or a few values of ``cost``, so the
    rows behind it may lie anywhere.
    """
    at = np.zeros(size)
    value, slope = cost(at)
    first = float(np.linalg.norm(slope))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(slope) <= tolerance * first:
            break
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s @ way) / (y @ s))
            way -= shares[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / first
        for (s, y), share in zip(steps, reversed(shares)):
            way += s * (share - (y @ way) / (y @ s))
        size_of_step, gain = 1.0, slope @ way
        then, ahead = cost(at - way)
        while then > value - 1e-4 * size_of_step * gain and size_of_step > 1e-6:
            size_of_step /= 4
            then, ahead = cost(at - size_of_step * way)
        if then > value:
            break
        s, y = -size_of_step * way, ahead - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        at, value, slope = at + s, then, ahead
    return at
