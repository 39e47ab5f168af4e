"""A logistic curve through counts: scores of a classifier become probabilities."""

from __future__ import annotations

import numpy as np


def calibrate(x: np.ndarray, n1: np.ndarray, n0: np.ndarray, hold: float = 0.05) -> tuple[float, float]:
    """Slope and shift of a logistic curve through counts at logits x, by Newton steps, held slightly to (1, 0)."""
    slope, shift = 1.0, 0.0
    total = max(1.0, float(n1.sum() + n0.sum()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        r, v = n1 - (n1 + n0) * p, (n1 + n0) * p * (1 - p)
        g = np.array([(r * x).sum() - hold * (slope - 1), r.sum() - hold * shift]) / total
        h = np.array([[(v * x * x).sum() + hold, (v * x).sum()], [(v * x).sum(), v.sum() + hold]]) / total
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (slope, shift) if slope > 0 else (1.0, 0.0)
