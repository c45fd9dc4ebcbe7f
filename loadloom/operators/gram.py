"""Least squares from moments, with lower bounds."""

from __future__ import annotations

import numpy as np


def bounded(g: np.ndarray, c: np.ndarray, low: np.ndarray, penalty: np.ndarray | None = None, ridge: float = 1e-9, held: np.ndarray | None = None) -> np.ndarray:
    """Least squares from moments with lower bounds: columns scaled, lightly ridged, then an active set.

    Coefficients are exchanged between those at their bound and the free ones while the conditions of optimality (none below its bound,
    no gradient inwards at one) fail: all that fail at once as long as that makes them fewer, else the last of them only, which ends.
    ``held`` may name the coefficients to try at their bound first.
    """
    p = len(c)
    a = g + (penalty if penalty is not None else 0.0)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scale[scale < 1e-12 * scale.max()] = 1.0
    a = a / np.outer(scale, scale)
    a[np.diag_indices(p)] += ridge * np.trace(a) / p
    b, floor = c / scale, np.where(np.isfinite(low), low * scale, -np.inf)
    free = np.ones(p, dtype=bool) if held is None else ~(held & np.isfinite(low))
    x, fewest, tries, tolerance = np.zeros(p), p + 1, 3, 1e-10 * max(np.abs(b).max(), 1e-300)
    for _ in range(5 * p + 50):
        x[~free] = floor[~free]
        x[free] = np.linalg.solve(a[np.ix_(free, free)], b[free] - a[np.ix_(free, ~free)] @ x[~free])
        wrong = (free & (x < floor - 1e-12)) | (~free & (a @ x - b < -tolerance))
        n = int(wrong.sum())
        if not n:
            break
        if n < fewest:
            fewest, tries = n, 3
        elif tries:
            tries -= 1
        else:
            last = np.flatnonzero(wrong)[-1]
            wrong = np.zeros(p, dtype=bool)
            wrong[last] = True
        free ^= wrong
    return np.maximum(x, floor) / scale
