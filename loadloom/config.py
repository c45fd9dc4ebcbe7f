"""Fixed values of the model: site, calendar, structure, parameter bounds and priors."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values
LATITUDE, LONGITUDE, ZONE = 49.8, 15.5, "Europe/Prague"
DARK_MIDDLE, DARK_WIDTH, GLOOM_LIGHT = -2.0, 1.5, 40.0
STEP_MINUTES, SLOTS_A_DAY, GAP_LIMIT = 15, 96, 4

FIXED_HOLIDAYS = ("01-01", "05-01", "05-08", "07-05", "07-06", "09-28", "10-28", "11-17", "12-24", "12-25", "12-26")
EASTER_HOLIDAYS = (-2, 1)
SHOPS_CLOSED = ("01-01", "05-08", "09-28", "10-28", "12-25", "12-26")
SHOPS_CLOSED_EASTER = (1,)
LONGEST_BRIDGE = 2
SUMMER_HOLIDAYS = ("07-01", "08-31")
SUMMER_COURSE = ("06-10", "09-20")
SUMMER_KNOT, SUMMER_HARMONICS = 10.0, 2
IRREGULAR_RANGE = ("12-21", "01-03")
CONTEXT_RANGE, CONTEXT_DAYS = ("12-22", "01-03"), 3


@dataclass(frozen=True)
class Period:
    """Days of the year with a daily shape of their own; a range may pass New Year."""

    name: str
    ranges: tuple[tuple[str, str], ...]
    harmonics: int
    days: str = "all"  # all, working or off
    bridges_only: bool = False


# Periods of the year with a daily shape of their own
PERIODS = (
    Period("stedry_den", (("12-24", "12-24"),), 8),
    Period("bozi_hod", (("12-25", "12-25"),), 4),
    Period("sv_stepan", (("12-26", "12-26"),), 4),
    Period("mezi_svatky_prac", (("12-27", "12-31"),), 4, days="working"),
    Period("mezi_svatky_vikend", (("12-27", "12-31"),), 2, days="off"),
    Period("silvestr", (("12-31", "12-31"),), 4),
    Period("novy_rok", (("01-01", "01-01"),), 8),
    Period("most_vanoce", (("12-20", "12-23"), ("01-02", "01-06")), 2, bridges_only=True),
)

# Structure of base, heating, cooling and generation, weight of the priors, corrections, refit policy
BASE = {"profile": 12, "holiday": 4, "bridge": 2, "knot_days": 90, "smooth": 500.0, "mild": (14.0, 18.0), "mild_before": (12.5, 19.5), "anchor": 1.0, "night_end": 10.0, "night_knot": 2.0}
LIGHT_WINDOWS, LIGHT_KNOT = ((3.0, 8.5), (15.0, 23.0)), 1.0
GLOOM_WINDOW, GLOOM_KNOT = (5.0, 21.0), 2.0
HEATING = {"harmonics": 4, "off_harmonics": 4, "inside": 20.0, "cold": 17.0, "cop_floor": 0.2, "trend_penalty": 5.0, "trend_harmonics": 2}
COOLING = {"harmonics": 4, "off_harmonics": 4, "reference": 25.0, "eer_floor": 0.3}
PV = {"knot_days": 90, "penalty": 5.0, "reference": 25.0}
PRIOR_WEIGHT, PRIOR_RMSE = 0.01, 15.0
CORRECTION = {"shape_days": 7, "shape_least": 5, "warm_up": 21, "ridge": 1e-3, "last": 4}
REFIT = {"linear_days": 1, "shape_days": 7, "revised_rows": 96}

# Edges and quantiles of the calibration of sunshine, and the 80 % quantile of a normal error
CLOUD_EDGES = tuple(float(x) for x in range(0, 101, 10))
ELEVATION_EDGES = (0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9)
KT_QUANTILES = tuple(round(0.05 + 0.1 * k, 2) for k in range(10))
CELL_LEAST, CLEAR_LEAST = 30, 10.0
Z80 = 1.2816


@dataclass(frozen=True)
class Shape:
    """A nonlinear parameter: bounds, start, and a prior (mean, sd) or a fixed value."""

    name: str
    low: float
    high: float
    start: float
    prior: tuple[float, float] | None = None
    fixed: float | None = None


# Bounds, starts and priors of the shapes
HEATING_SHAPES = (
    Shape("a", 0, 0.05, 0.01),
    Shape("b", 0, 0.03, 0.005),
    Shape("t_b", 10, 18, 14.5, (17, 1.5)),
    Shape("s", 0.5, 6, 2.5, (2, 1)),
    Shape("w", 0, 1, 0.5),
    Shape("tau", 4, 120, 36, (80, 20)),
    Shape("alpha", 0, 0.06, 0.02, (0.012, 0.008)),
)
COOLING_SHAPES = (
    Shape("a_c", 0, 0.10, 0.02),
    Shape("t_bc", 16, 26, 21, (18, 1.5)),
    Shape("s_c", 0.5, 6, 2, (2, 1)),
    Shape("w_c", 0, 1, 0.5),
    Shape("tau_c", 0.25, 72, 6),
    Shape("alpha_c", 0, 0.06, 0.02),
)
PV_SHAPES = (Shape("gamma", 0, 0.01, 0.004, fixed=0.004),)
