"""Small linear models, fitted on the driver from bounded labelled tables and applied as SQL expressions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-3, l1: float = 0.0, steps: int = 400, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights [feature, class] and biases of a multinomial logistic regression, by proximal gradient steps with
    momentum. l1 makes weights sparse."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    truth = np.eye(classes)[y]
    size = max(1.0, float((x * x).sum(1).max())) / 2
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        gap = (p / p.sum(1, keepdims=True) - truth) / len(x)
        vw = 0.9 * vw - rate / size * (x.T @ gap + l2 * w)
        vb = 0.9 * vb - rate / size * gap.sum(0)
        w, b = w + vw, b + vb
        if l1:
            w = np.sign(w) * np.maximum(np.abs(w) - rate / size * l1, 0)
    return w, b


def constant(values: list[float]) -> Column:
    """An array of doubles as one literal."""
    return F.from_json(F.lit(json.dumps([round(float(v), 9) for v in values])), "array<double>")
