"""Logistic regression on sparse hashed features, and Platt calibration; the steps of a fit are plain numpy.

``fit_logistic`` and ``fit_platt`` take a bounded table; ``minimise`` and ``newton_platt`` ask a function for sums, which
may come from a job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, most: int = 32, history: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with halved steps: the best point within ``most`` calls of ``loss``, which returns value and gradient.

    It ends earlier once the gradient is ``tolerance`` times as long as at the start.
    """
    value, grad = loss(at)
    first, pairs, calls = np.linalg.norm(grad), [], 1
    while calls < most and np.linalg.norm(grad) > tolerance * first:
        way, used = grad.copy(), []
        for s, y in reversed(pairs):
            used.append((s @ way) / (s @ y))
            way -= used[-1] * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / np.linalg.norm(grad)
        for (s, y), a in zip(pairs, reversed(used)):
            way += (a - (y @ way) / (s @ y)) * s
        scale, slope = 1.0, grad @ way
        while calls < most:
            to = at - scale * way
            then, new = loss(to)
            calls += 1
            if then <= value - 1e-4 * scale * slope:
                break
            scale /= 2
        else:
            break
        if (to - at) @ (new - grad) > 0:
            pairs = [*pairs[1 - history :], (to - at, new - grad)] if history > 1 else [(to - at, new - grad)]
        at, value, grad = to, then, new
    return at


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, l2: float = 1e-5, steps: int = 200, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of the class-balanced penalised log loss; ``rows`` are (feature indices, values) per example.

    Full-batch Adam with a fixed number of steps, so equal rows give equal weights. With one class only, the weights
    are zero and the bias follows that class.
    """
    y = np.asarray(y, float)
    weight = np.zeros(width)
    if not len(y) or y.min() == y.max():
        return weight, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    size = np.array([len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), size)
    importance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    bias, m, s = 0.0, np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * weight[index], minlength=len(rows)) + bias
        residual = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(index, value * residual[row], minlength=width) + l2 * weight, residual.sum())
        m = 0.9 * m + 0.1 * grad
        s = 0.999 * s + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    return weight, float(bias)


def fit_platt(score: np.ndarray, y: np.ndarray, most_steps: int = 200) -> tuple[float, float]:
    """(slope, offset) so that ``1 / (1 + exp(-(slope * score + offset)))`` is the probability of class 1.

    Newton steps with halving on Platt's smoothed targets; without both classes the score is left as it is.
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)

    def sums(slope: float, offset: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = x @ np.array([slope, offset])
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return float((np.logaddexp(0, z) - target * z).sum()), x.T @ (p - target), (x.T * (p * (1 - p))) @ x

    return newton_platt(sums, up, down, most_steps)


def newton_platt(sums: Callable[[float, float], tuple[float, np.ndarray, np.ndarray]], up: int, down: int, most_steps: int = 200) -> tuple[float, float]:
    """Slope and offset by Newton steps with halving, from a function that returns loss, gradient and Hessian at both."""
    now = np.array([0.0, np.log((up + 1) / (down + 1))])
    loss, grad, curve = sums(*now.tolist())
    for _ in range(most_steps):
        step = np.linalg.solve(curve + 1e-9 * np.eye(2), grad)
        scale = 1.0
        then = sums(*(now - step).tolist())
        while then[0] > loss and scale > 1e-9:
            scale /= 2
            then = sums(*(now - scale * step).tolist())
        now = now - scale * step
        loss, grad, curve = then
        if np.abs(scale * step).max() < 1e-10:
            break
    return float(now[0]), float(now[1])
