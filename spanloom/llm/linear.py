"""Small linear models on hashed text features, in NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Hashed byte n-grams of a text.
GRAMS = 2048


def grams(text: str, n: int = 2, lower: bool = False) -> np.ndarray:
    """Relative frequencies of hashed byte n-grams (2 or 3) as square roots: unit length in the 2-norm."""
    raw = np.frombuffer((text.lower() if lower else text).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < n:
        raw = np.concatenate([raw, np.full(n - len(raw), 32, np.uint32)])
    code = raw[: len(raw) - n + 1] * np.uint32(0x9E3779B1) + raw[1 : len(raw) - n + 2] * np.uint32(0x85EBCA6B)
    if n == 3:
        code = code + raw[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    count = np.bincount(code * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=GRAMS).astype(np.float32)
    return np.sqrt(count / count.sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], curve: float, weight: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weights and bias by Nesterov's steps; slope gives the loss's derivative by margin, curve bounds its second one.

    The bias is kept apart from the rows, and squared lengths come without a copy of them, so that a fit needs no
    memory beside x but vectors.
    """
    weight = (weight / weight.sum()).astype(np.float32)
    rate = 1 / (curve * (float(weight @ np.einsum("ij,ij->i", x, x)) + 1) + l2)
    w = v = np.zeros(x.shape[1], np.float32)
    b = c = np.float32(0)
    for t in range(steps):
        pull = (weight * slope(x @ v + c)).astype(np.float32)
        new, bias = v - np.float32(rate) * (x.T @ pull + np.float32(l2) * v), c - np.float32(rate * pull.sum())
        push = np.float32(t / (t + 3))
        v, w = new + push * (new - w), new
        c, b = bias + push * (bias - b), bias
    return np.r_[w, b].astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a logistic model; rows of weight 0 take no part."""
    return _descend(x, lambda m: sigmoid(m) - y, 0.25, np.ones(len(x)) if weight is None else weight, l2, steps)


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss; y is -1 or 1. Classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    return _descend(x, lambda m: -2 * y * np.maximum(0, 1 - y * m), 2, weight, l2, steps)


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that turn margins into probabilities; the slope is never negative."""
    hits = y > 0.5
    y = np.where(hits, (hits.sum() + 1) / (hits.sum() + 2), 1 / ((~hits).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * m + b)
        g = np.array([((p - y) * m).sum(), (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a - np.clip(da, -5, 5), 1e-3), b - np.clip(db, -5, 5)
    return float(a), float(b)
