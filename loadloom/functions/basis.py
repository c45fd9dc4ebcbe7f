"""Basis functions as array columns: Fourier, B-splines, ramps and products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom import config as C


def fourier(tod: Column, k: int) -> Column:
    """Cosines, then sines, of the first k harmonics of a day."""
    angle = [tod * (2 * math.pi * j / 24) for j in range(1, k + 1)]
    return F.array(*(F.cos(x) for x in angle), *(F.sin(x) for x in angle))


def evenly(a: float, b: float, step: float) -> list[float]:
    """Knots over the whole window, spaced as near to ``step`` as fits."""
    n = max(int(round((b - a) / step)), 1)
    return [a + (b - a) * i / n for i in range(n + 1)]


def bspline(x: Column, inner: list[float]) -> list[Column]:
    """Clamped cubic B-splines over the knots ``inner``, by the Cox-de Boor recurrence on literal knots."""
    t = [inner[0]] * 3 + inner + [inner[-1]] * 3
    last = len(inner) + 1  # index of the last interval that isn't empty
    level = [F.when((x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1])), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for degree in (1, 2, 3):
        following = []
        for i in range(len(t) - 1 - degree):
            term = F.lit(0.0)
            if t[i + degree] > t[i]:
                term = term + (x - t[i]) / (t[i + degree] - t[i]) * level[i]
            if t[i + degree + 1] > t[i + 1]:
                term = term + (t[i + degree + 1] - x) / (t[i + degree + 1] - t[i + 1]) * level[i + 1]
            following.append(term)
        level = following
    return level


def cubic_pieces(inner: list[float]) -> list[list[list[float]]]:
    """For each interval of evenly spaced knots, the four splines that aren't zero there, as polynomials of the distance to its start."""
    t = np.array([inner[0]] * 3 + inner + [inner[-1]] * 3)
    out = []
    for k in range(len(inner) - 1):
        u = np.linspace(0.1, 0.9, 4) * (inner[k + 1] - inner[k])
        x = inner[k] + u
        level = [np.where(i == k + 3, 1.0, 0.0) * np.ones(4) for i in range(len(t) - 1)]
        for d in (1, 2, 3):
            share = lambda i, d=d: (x - t[i]) / (t[i + d] - t[i]) if t[i + d] > t[i] else np.zeros(4)
            level = [share(i) * level[i] + (1 - share(i + 1)) * (t[i + d + 1] > t[i + 1]) * level[i + 1] for i in range(len(t) - 1 - d)]
        out.append(np.linalg.solve(np.vander(u, 4, increasing=True), np.array(level[k : k + 4]).T).T.tolist())
    return out


def bspline_at(x: Column, inner: list[float]) -> Column:
    """The same over evenly spaced knots as an array, for x within them: the interval selects four cubics from a table, and all other
    splines are zero, so the expression stays small however many splines there are."""
    n, a, h = len(inner) - 1, inner[0], (inner[-1] - inner[0]) / (len(inner) - 1)
    k = F.least(F.greatest(F.floor((x - a) / h), F.lit(0)), F.lit(n - 1)).cast("int")
    u = x - (a + h * k)
    four = F.transform(F.element_at(F.lit(cubic_pieces(inner)), k + 1), lambda p: p[0] + u * (p[1] + u * (p[2] + u * p[3])))
    return F.concat(F.array_repeat(F.lit(0.0), k), four, F.array_repeat(F.lit(0.0), n - 1 - k))


def window_basis(x: Column, a: float, b: float, step: float) -> Column:
    """Splines over [a, b) without two at either end: value and slope are zero at the edges, and all is zero outside."""
    inside = (x >= a) & (x < b)
    clipped = F.greatest(F.least(x, F.lit(b)), F.lit(a))
    knots = evenly(a, b, step)
    n = len(knots) - 2  # len + 2 splines, without two at either end
    return F.when(inside, F.slice(bspline_at(clipped, knots), 3, n)).otherwise(F.array_repeat(F.lit(0.0), n))


def night_basis(tod: Column) -> Column:
    """Splines from midnight to the end of the morning, without the last two."""
    end, step = C.BASE["night_end"], C.BASE["night_knot"]
    inner = [step * i for i in range(int(end / step + 1e-9) + 1)]
    clipped = F.greatest(F.least(tod, F.lit(end)), F.lit(0.0))
    n = len(inner)
    return F.when(tod < end, F.slice(bspline_at(clipped, inner), 1, n)).otherwise(F.array_repeat(F.lit(0.0), n))


def light_basis(tod: Column) -> Column:
    return F.concat(*(window_basis(tod, a, b, C.LIGHT_KNOT) for a, b in C.LIGHT_WINDOWS))


def gloom_basis(tod: Column) -> Column:
    return window_basis(tod, *C.GLOOM_WINDOW, C.GLOOM_KNOT)


def summer_basis(position: Column) -> Column:
    from loadloom.operators.calendar import summer_length

    return window_basis(position, 0.0, float(summer_length()), C.SUMMER_KNOT)


def level_knots(span_days: float) -> list[float]:
    step = float(C.BASE["knot_days"])
    return [step * i for i in range(math.ceil((span_days + step) / step - 1e-12))]


def level_basis(days: Column, span_days: float) -> Column:
    knots = level_knots(span_days)
    return bspline_at(F.greatest(F.least(days, F.lit(knots[-1] - 1e-9)), F.lit(0.0)), knots)


def ramps(days: Column, span_days: float, step: float = float(C.PV["knot_days"])) -> Column:
    """1, then ramps from 0 to 1 over ``step`` days, of those that the span holds whole; x stops at the span."""
    x = F.greatest(F.least(days, F.lit(float(span_days))), F.lit(0.0))
    starts = [step * i for i in range(1, int(math.floor((span_days - step) / step + 1e-9)) + 1)]
    return F.array(F.lit(1.0), *(F.greatest(F.least((x - j) / step, F.lit(1.0)), F.lit(0.0)) for j in starts))


def row_product(a: Column, b: Column) -> Column:
    """All products of two arrays, the first one's index moving slowest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
