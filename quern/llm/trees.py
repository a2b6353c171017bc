"""Gradient-boosted trees, fitted in numpy and written out as SQL."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float]:
    """The best (gain, feature, threshold) over ``rows``; a row goes left if its value is at most the threshold."""
    best = (0.0, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for t in values[:-1]:
            left = rows[x[rows, f] <= t]
            lg, lh = g[left].sum(), h[left].sum() + 1.0
            gain = lg * lg / lh + (total_g - lg) ** 2 / (total_h - lh + 1.0) - total_g * total_g / total_h
            if gain > best[0] + 1e-9:
                best = (float(gain), f, float(t))
    return best


def _leaf(g: np.ndarray, h: np.ndarray, rows: np.ndarray, rate: float) -> float:
    return float(-rate * g[rows].sum() / (h[rows].sum() + 1.0)) if len(rows) else 0.0


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, rate: float = 0.4, depth: int = 2) -> list:
    """Trees as nested (feature, threshold, left, right) with numbers as leaves; their sum is a log odds."""
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        every = np.arange(len(y))

        def grow(rows, depth, g=g, h=h):
            gain, f, t = _split(x, g, h, rows) if depth and len(rows) else (0.0, -1, 0.0)
            if f < 0:
                return _leaf(g, h, rows, rate)
            low = x[rows, f] <= t
            return (f, t, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

        tree = grow(every, depth)
        out.append(tree)
        z += np.array([value(tree, row) for row in x])
    return out


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def as_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, t, low, high = tree
    return f"CASE WHEN {names[f]} <= {t!r}D THEN {as_sql(low, names)} ELSE {as_sql(high, names)} END"
