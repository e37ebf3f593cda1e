"""Follow-the-regularised-leader with elastic-net penalties for a sparse multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate proximal updates; the last row of the weights is the intercept, which has no penalty."""

    def __init__(self, features: int, classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta = alpha, beta
        self.l1 = np.full((features + 1, 1), l1)
        self.l2 = np.full((features + 1, 1), l2)
        self.l1[-1] = self.l2[-1] = 0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2[at])
        return np.where(np.abs(z) > l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        """One example: features ``at`` with values ``x`` (the intercept included), and its class probabilities."""
        w = self.weights(at)
        g = np.outer(x, softmax(x @ w) - target)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
        """``rows``: feature numbers and values of each example; returns the weights."""
        order, last = np.random.default_rng(seed), len(self.z) - 1
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                at, x = rows[k]
                self.update(np.append(at, last), np.append(x, 1.0), targets[k])
        return self.weights()


def logits(weights: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ weights[at] + weights[-1]


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood of the true classes."""
    def loss(t):
        return -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-300)).mean()

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    return float(min(grid, key=loss)) if len(truth) else 1.0
