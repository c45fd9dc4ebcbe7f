"""Response functions of heating, cooling and solar generation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom import config as C


def softplus(z: Column, s: float | Column) -> Column:
    """Smooth max(z, 0) of width ``s``; the line itself where the exponential would overflow."""
    scale = F.lit(s) if isinstance(s, (int, float)) else s
    return F.when(z / scale > 30, z).otherwise(scale * F.log1p(F.exp(F.least(z / scale, F.lit(30.0)))))


def felt_temperature(temp: Column, sun: Column, wind: Column | None, a: float, b: float = 0.0) -> Column:
    felt = temp + F.lit(a) * sun
    return felt if wind is None else felt - F.lit(b) * wind * F.greatest(C.HEATING["inside"] - temp, F.lit(0.0))


def cop(temp: Column, alpha: float) -> Column:
    return F.greatest(1 + F.lit(alpha) * temp, F.lit(C.HEATING["cop_floor"]))


def eer(temp: Column, alpha: float) -> Column:
    return F.greatest(1 - F.lit(alpha) * (temp - C.COOLING["reference"]), F.lit(C.COOLING["eer_floor"]))


def pv_efficiency(temp: Column, gamma: float) -> Column:
    return 1 - F.lit(gamma) * (temp - C.PV["reference"])


def heating_shape(temp: Column, star: Column, t_b: float, s: float, alpha: float) -> Column:
    return softplus(F.lit(t_b) - star, s) / cop(temp, alpha)


def cooling_shape(temp: Column, star: Column, t_bc: float, s_c: float, alpha_c: float) -> Column:
    return softplus(star - F.lit(t_bc), s_c) / eer(temp, alpha_c)
