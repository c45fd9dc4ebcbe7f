"""Production: when to fit again, and the forecast from the end of the data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans import intraday as I
from loadloom.plans.design import Layout
from loadloom.sources.store import archive


PARTS = ("base", "heating", "cooling", "pv")


@dataclass(frozen=True)
class State:
    """What a stored fit says of itself."""

    fitted_at: datetime
    shapes_at: datetime
    span_days: int


def refit(state: State | None, now: datetime, revised_rows: int, force: str = "auto", edited: bool = False, pins_changed: bool = False) -> str:
    """``shapes``, ``linear`` or ``keep``.

    Shapes are fitted anew without a state, on demand, or after a week; coefficients after a day, a day's worth of revised rows, changed
    pins, or an edit of the stored parameters, which counts even where the caller asks to keep them.
    """
    if state is None or force == "shapes":
        return "shapes"
    if force == "keep":
        return "linear" if edited else "keep"
    if (now - state.shapes_at).days >= C.REFIT["shape_days"]:
        return "shapes"
    stale = (now - state.fitted_at).days >= C.REFIT["linear_days"] or revised_rows >= C.REFIT["revised_rows"]
    return "linear" if stale or pins_changed or edited or force == "linear" else "keep"


def update(chunks: DataFrame, hourly: DataFrame, params: DataFrame | None, layout: Layout, step_hours: float, what: str, passes: int = 8) -> DataFrame:
    """Parameters after the decision: shapes from chunks of hourly means (from scratch, or warm from ``params``), coefficients from all rows."""
    if what == "keep" and params is not None:
        return params
    if what == "linear" and params is not None:
        shapes = params
    elif params is not None:
        shapes = M.joint(None, layout, 1.0, passes=passes, params=params, chunks=hourly)
    else:
        shapes = M.from_scratch(None, layout, 1.0, passes=passes, chunks=hourly)
    return M.linear(None, layout, step_hours, shapes, chunks)


def edits(shown: dict[str, float], stored: dict[str, float], digits: int = 6) -> dict[str, float]:
    """Shapes whose shown value differs from the stored one at ``digits`` significant digits: someone edited them."""
    short = lambda v: float(f"{v:.{digits}g}")
    return {k: v for k, v in shown.items() if k in stored and short(v) != short(stored[k])}


def changed_pins(pins: dict[str, float], stored: dict[str, float]) -> list[str]:
    """Pinned shapes whose value isn't the stored one."""
    return [k for k, v in pins.items() if stored.get(k) != v]


def forecast(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, coefs: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Forecast of the rows after a series' last known load: the components, the model, the correction by horizon and their sum.

    ``chunks``: history and horizon, with forecast weather in the place of measured after the end of the data; a row without weather
    isn't forecast. ``coefs``: series_id, h and a coefficient for each of the intraday features (see ``plans.intraday``); without, there is
    no correction. With ``path``, the result is archived under its issue instant.
    """
    told = M.predict(chunks, params, layout, step_hours)
    step = int(3600 * step_hours)
    a_day = 86400 // step
    rows = told.select(SERIES, "ts", (F.unix_timestamp("ts") / step).cast("long").alias("k"), "load", *PARTS, "model", (F.col("load") - F.col("model")).alias("r"))
    ends = rows.filter("load is not null").groupBy(SERIES).agg(F.max("k").alias("_k"), (F.max("ts") + F.expr(f"interval {step} seconds")).alias("issued_at"))
    ahead = rows.join(ends, SERIES).filter((F.col("k") > F.col("_k")) & F.col("model").isNotNull() & ~F.isnan("model")).withColumn("h", (F.col("k") - F.col("_k") - 1).cast("int"))
    if coefs is None:
        out = ahead.withColumn("correction", F.lit(0.0))
    else:
        known = I.known_at(rows.filter("load is not null"), a_day, ahead=1).select(SERIES, (F.col("k") + 1).alias("_s"), "x1", "xday")
        past = I.slot_means(rows, a_day)
        laid = ahead.withColumns({"_s": F.col("_k") + 1, "back": F.col("k") - a_day * (F.floor(F.col("h") / a_day) + 1)})
        laid = laid.join(known, [SERIES, "_s"], "left").join(past, [SERIES, "back"], "left")
        named = coefs.select(SERIES, "h", *(F.col(f).alias(f"coef_{f}") for f in I.FEATURES))
        terms = sum((F.coalesce(F.col(f"coef_{f}") * F.col(f), F.lit(0.0)) for f in I.FEATURES), F.lit(0.0))
        out = laid.join(named, [SERIES, "h"], "left").withColumn("correction", terms)
    out = out.select(SERIES, "issued_at", "ts", "h", *PARTS, "model", "correction", (F.col("model") + F.col("correction")).alias("pred"))
    if path is not None:
        archive(out, path)
    return out
