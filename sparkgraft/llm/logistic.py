"""A small logistic regression, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30, row_weights: np.ndarray | None = None) -> Logistic:
        """Newton's method with an L2 penalty on all weights but the intercept."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        ridge = np.diag([penalty] * x.shape[1] + [1e-6])
        share = np.ones(len(x)) if row_weights is None else row_weights
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = sigmoid(z @ w)
            gradient = z.T @ (share * (y - p)) - ridge @ w
            step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), gradient)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def step(self, x: np.ndarray, y: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, penalty: float = 1.0, most: float = 3.0) -> Logistic:
        """The model after one step of Newton's method over these rows and others, of which the sums are given; no weight moves further than `most`."""
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        ridge = np.diag([penalty] * x.shape[1] + [1e-6])
        p = sigmoid(z @ self.weights)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + curvature + ridge + 1e-9 * np.eye(len(ridge)), z.T @ (y - p) + gradient - ridge @ self.weights)
        return Logistic(self.mean, self.scale, self.weights + step * min(1.0, most / max(1e-12, np.abs(step).max())))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))
