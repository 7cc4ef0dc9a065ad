"""A logistic model fitted with numpy: on rows at hand, or by sums over rows wherever they are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the rows' loss; both add up over rows. x ends with a column of ones."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p) + 1e-6)[:, None]).T @ x


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """n weights (last: intercept) by damped Newton steps over the sums of all rows."""
    w = np.zeros(n)
    ridge = np.full(n, l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        grad, h = sums(w)
        step = np.linalg.solve(h + np.diag(ridge), grad + ridge * w)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) for targets in [0, 1]."""
    x = np.hstack([x, np.ones((len(x), 1))])
    return newton(lambda w: logistic_sums(x, y, w), x.shape[1], l2, rounds)


def predict_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
