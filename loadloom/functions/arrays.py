"""The bases and responses of the model on numpy arrays, for designs that are built inside tasks. See ``basis`` and ``physics`` for the
same as Column expressions; tests hold the two against each other."""

from __future__ import annotations

from functools import cache

import numpy as np

from loadloom import config as C
from loadloom.functions.basis import cubic_pieces, evenly, level_knots

#: Rows that a filter handles as one matrix product.
BLOCK = 64


def fourier(tod: np.ndarray, k: int) -> np.ndarray:
    angle = np.outer(tod, np.arange(1, k + 1)) * (2 * np.pi / 24)
    return np.hstack([np.cos(angle), np.sin(angle)])


@cache
def _pieces(inner: tuple[float, ...]) -> np.ndarray:
    return np.array(cubic_pieces(list(inner)))


def splines(x: np.ndarray, inner: list[float]) -> np.ndarray:
    """Clamped cubic B-splines over evenly spaced knots, for x within them."""
    n, a, h = len(inner) - 1, inner[0], (inner[-1] - inner[0]) / (len(inner) - 1)
    k = np.clip(np.floor((x - a) / h).astype(int), 0, n - 1)
    powers = np.vander(x - (a + h * k), 4, increasing=True)
    four = np.einsum("rij,rj->ri", _pieces(tuple(inner))[k], powers)
    out = np.zeros((len(x), n + 3))
    np.put_along_axis(out, k[:, None] + np.arange(4), four, axis=1)
    return out


def window_basis(x: np.ndarray, a: float, b: float, step: float) -> np.ndarray:
    inside = (x >= a) & (x < b)
    return splines(np.clip(x, a, b), evenly(a, b, step))[:, 2:-2] * inside[:, None]


def night_basis(tod: np.ndarray) -> np.ndarray:
    end, step = C.BASE["night_end"], C.BASE["night_knot"]
    inner = [step * i for i in range(int(end / step + 1e-9) + 1)]
    return splines(np.clip(tod, 0.0, end), inner)[:, : len(inner)] * (tod < end)[:, None]


def light_basis(tod: np.ndarray) -> np.ndarray:
    return np.hstack([window_basis(tod, a, b, C.LIGHT_KNOT) for a, b in C.LIGHT_WINDOWS])


def level_basis(days: np.ndarray, span_days: float) -> np.ndarray:
    knots = level_knots(span_days)
    return splines(np.clip(days, 0.0, knots[-1] - 1e-9), knots)


def ramps(days: np.ndarray, span_days: float, count: int, step: float = float(C.PV["knot_days"])) -> np.ndarray:
    """1, then ``count`` ramps from 0 to 1 over ``step`` days; time stops at the span."""
    x = np.clip(days, 0.0, span_days)
    return np.column_stack([np.ones(len(x)), *(np.clip((x - step * i) / step, 0.0, 1.0) for i in range(1, count + 1))])


def row_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def softplus(z: np.ndarray, s: float) -> np.ndarray:
    q = z / s
    return np.where(q > 30, z, s * np.log1p(np.exp(np.minimum(q, 30.0))))


def smoothed(x: np.ndarray, decay: float) -> np.ndarray:
    """y[t] = decay y[t-1] + (1 - decay) x[t] from y = x[0], as products of whole blocks with a triangular matrix and a short carry."""
    n = len(x)
    if not n:
        return x
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK)
    padded[:n] = x
    powers = decay ** np.arange(BLOCK + 1)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    kernel = np.where(lag >= 0, (1 - decay) * powers[np.maximum(lag, 0)], 0.0)
    alone = padded.reshape(blocks, BLOCK) @ kernel.T
    carry, entering = x[0], np.empty(blocks)
    for b in range(blocks):
        entering[b] = carry
        carry = powers[BLOCK] * carry + alone[b, -1]
    return (alone + entering[:, None] * powers[1:]).reshape(-1)[:n]
