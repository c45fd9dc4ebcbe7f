"""Sun position and daylight as Column expressions; instants are UTC timestamps, angles degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom import config as C


def orbit(day_of_year: Column, hour: Column) -> tuple[Column, Column]:
    """Equation of time (minutes) and declination (radians), the published low-precision Fourier series (fixed values)."""
    g = F.lit(2 * math.pi / 365) * (day_of_year - 1 + (hour - 12) / 24)
    time = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    tilt = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    return time, tilt


def hour_of(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def cos_zenith(ts: Column) -> Column:
    hour = hour_of(ts)
    time, tilt = orbit(F.dayofyear(ts), hour)
    angle = F.radians((hour * 60 + time + 4 * C.LONGITUDE) / 4 - 180)
    lat = math.radians(C.LATITUDE)
    return math.sin(lat) * F.sin(tilt) + math.cos(lat) * F.cos(tilt) * F.cos(angle)


def elevation(ts: Column) -> Column:
    return 90 - F.degrees(F.acos(F.greatest(F.least(cos_zenith(ts), F.lit(1.0)), F.lit(-1.0))))


def sun_minutes(date: Column) -> tuple[Column, Column]:
    """Sunrise and sunset as minutes of the UTC day (refraction included: zenith 90.833)."""
    time, tilt = orbit(F.dayofyear(date), F.lit(12.0))
    lat = math.radians(C.LATITUDE)
    half = F.degrees(F.acos(math.cos(math.radians(90.833)) / (math.cos(lat) * F.cos(tilt)) - math.tan(lat) * F.tan(tilt)))
    return 720 - 4 * (C.LONGITUDE + half) - time, 720 - 4 * (C.LONGITUDE - half) - time


def darkness(elev: Column) -> Column:
    """0 by day, 1 after civil twilight, logistic between."""
    return 1 / (1 + F.exp((elev - C.DARK_MIDDLE) / C.DARK_WIDTH))


def shifted(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"interval {seconds} seconds")


def minute_fraction_elevation(ts: Column, seconds: int) -> Column:
    """Elevation a whole number of minutes after ``ts``; the hour counts whole minutes only."""
    return elevation(shifted(ts, seconds))


def darkness_of_slot(ts: Column) -> Column:
    """Mean darkness of the quarter hour that starts at ``ts``, from three instants."""
    return (darkness(elevation(shifted(ts, 150))) + darkness(elevation(shifted(ts, 450))) + darkness(elevation(shifted(ts, 750)))) / 3


def gloom(dark: Column, light: Column) -> Column:
    """Dimness of a day for lack of light; none by night, which darkness carries."""
    return (1 - dark) * F.exp(-F.greatest(light, F.lit(0.0)) / C.GLOOM_LIGHT)


def clear_sky(ts: Column) -> Column:
    """Global irradiance of a cloudless sky (Haurwitz; fixed values), W/m2."""
    cz = F.greatest(cos_zenith(ts), F.lit(0.0))
    return F.when(cz > 0.01, 1098.0 * cz * F.exp(-0.057 / cz)).otherwise(0.0)
