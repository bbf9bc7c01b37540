"""Centroids of a bounded sample, shared by the vector operators."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
        c[filled] = np.add.reduceat(x[order], starts, axis=0) / size[filled][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, many: int) -> np.ndarray:
    """The `many` nearest rows of c for each row of x, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (c**2).sum(axis=1) - 2 * x[i : i + 4096] @ c.T
        few = np.argpartition(d, min(many, len(c)) - 1, axis=1)[:, :many]
        out.append(np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, many), int)
