"""Small ridge logistic regression, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0, steps: int = 30) -> dict:
    """Newton steps on standardised features; the classes weigh as in the population, where
    class 1 has the given share, whatever their numbers in the sample."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    own = float(y.mean())
    w = np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    beta = np.zeros(z.shape[1])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (y - p)) - penalty @ beta
        hessian = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


def predict_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(model["beta"][0] + z @ model["beta"][1:], -30, 30)))
