"""Brute-force references used only by the tests (small inputs)."""

from __future__ import annotations

import numpy as np


def dbscan_brute(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Sequential DBSCAN in row order: clusters numbered by their first core
    point, border points keep the first cluster that reaches them."""
    n = len(x)
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_samples
    lab = np.full(n, -1)
    c = 0
    for i in range(n):
        if not core[i] or lab[i] != -1:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.nonzero(nb[p])[0]:
                if lab[q] == -1:
                    lab[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return lab


def kth_distance_brute(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, k - 1]
