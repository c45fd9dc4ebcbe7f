"""Small numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: Column, digits: int) -> Column:
    """Rounded to a number of significant digits; zero stays zero."""
    power = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def bin_left(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of inner edges at or below x: bins closed on the left, the outer ones open."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1]))
    return F.size(F.filter(inner, lambda e: e <= x))


def bin_right(x: Column, edges: tuple[float, ...]) -> Column:
    """Bin (from 0) closed on the right; null outside of the edges."""
    found = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < x)) - 1
    return F.when((x > edges[0]) & (x <= edges[-1]), found)


def between(v: Column, at: list[float]) -> tuple[Column, Column]:
    """The number (from 1) of the centre below and the share of the way to the next; held beyond the outer centres."""
    v = F.greatest(F.least(v, F.lit(at[-1])), F.lit(at[0]))
    centres = F.array(*(F.lit(c) for c in at))
    i = F.least(F.greatest(F.size(F.filter(centres, lambda c: c <= v)), F.lit(1)), F.lit(len(at) - 1))
    low, high = F.element_at(centres, i), F.element_at(centres, i + 1)
    return i, (v - low) / (high - low)


def blended(table: Column, i: Column, p: Column, j: Column, q: Column) -> Column:
    """A nested array at places that ``between`` gives."""
    cell = lambda a, b: F.element_at(F.element_at(table, i + a), j + b)
    return (1 - p) * ((1 - q) * cell(0, 0) + q * cell(0, 1)) + p * ((1 - q) * cell(1, 0) + q * cell(1, 1))


def bilinear(table: Column, x: Column, y: Column, xs: list[float], ys: list[float]) -> Column:
    """Interpolation of a nested array at bin centres, held beyond the outer centres."""
    return blended(table, *between(x, xs), *between(y, ys))


def rounded(places: int, *names: str) -> dict[str, Column]:
    """Columns rounded for comparison; negative zero becomes zero."""
    return {n: F.round(F.col(n), places) + F.lit(0.0) for n in names}
