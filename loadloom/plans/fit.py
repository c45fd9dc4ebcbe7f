"""Separable least squares for all components of many series at once.

A pass is one job: tasks read chunks of series, build their designs on arrays and send the moments of [base, shape-dependent columns,
derivatives, target]; each series and fold is then solved in its own task, which also moves the shapes. Only parameters travel between
passes. Coefficients come from bounded normal equations; the shapes move by damped Gauss-Newton steps on the problem with the coefficients
projected out, and a step that didn't help is taken back. All stages of a fit are solved from such moments: they differ in the rows that
count, the blocks that are free and the shapes that move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.gram import bounded
from loadloom.operators.timeaxis import SERIES
from loadloom.plans.chunks import DAYS, FIELDS, FORECAST, WEATHER, chunked
from loadloom.plans.design import FLAGS, NAMES, SHAPES, Layout, Responses, Rows
from loadloom.sources.store import dropped, written

FREE = [s.name for s in SHAPES if s.fixed is None]
BUMP = 1e-3
HEATING_NAMES = tuple(s.name for s in C.HEATING_SHAPES)
COOLING_NAMES = tuple(s.name for s in (*C.COOLING_SHAPES, *C.PV_SHAPES))
#: One row for each series and fold. ``best`` is the best state met, ``trial`` what the next pass evaluates.
STATE = "theta array<double>, coef array<double>, cost double, rmse double, n long, s array<double>, g array<double>"
PARAMS = f"{SERIES} string, fold string, span int, until long, since long, skip_first int, skip_last int, cuts array<long>, theta array<double>, coef array<double>, rmse double, n long, damping double, best struct<{STATE}>"
FAR = 1 << 60
BEFORE_FORECAST = tuple(f"before_{c}" for c in FORECAST[: len(WEATHER)])


@dataclass(frozen=True)
class Stage:
    """Rows that count (``all``, ``mild`` or ``cold`` days), blocks that are solved for (none named: all), shapes that move, and passes."""

    rows: str = "all"
    blocks: tuple[str, ...] = ()
    shapes: tuple[str, ...] = tuple(FREE)
    passes: int = 8


def staged(layout: Layout, passes: int = 8) -> list[Stage]:
    """The chain from scratch: base on mild days, heating on cold ones, cooling with generation, then everything."""
    return [
        Stage("mild", tuple(layout.base_names), (), 1),
        Stage("cold", ("heating",), HEATING_NAMES, 5),
        Stage("all", ("cooling", "pv"), tuple(n for n in COOLING_NAMES if n in FREE), 4),
        Stage(passes=passes),
    ]


def start(series: DataFrame, layout: Layout, theta: dict[str, float] | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """Starting parameters of every series (and of its folds: ``columns`` may give fold, span, until, since, skip_first, skip_last, cuts and
    theta); pinned shapes take their fixed value."""
    first = F.array(*(F.lit(float((theta or {}).get(s.name, s.fixed if s.fixed is not None else s.start))) for s in SHAPES))
    none = F.lit(None)
    unset = {
        "fold": F.lit(""), "span": F.lit(layout.span_days), "until": F.lit(FAR), "since": F.lit(-FAR), "skip_first": F.lit(1), "skip_last": F.lit(0),
        "cuts": F.array().cast("array<bigint>"), "theta": first, "coef": F.array().cast("array<double>"), "rmse": none.cast("double"), "n": F.lit(0).cast("long"), "damping": F.lit(0.05),
        "best": none.cast(f"struct<{STATE}>"),
    }
    return series.select(SERIES, *(c.alias(k) for k, c in (unset | (columns or {})).items())).select(SERIES, *(F.col(k) for k in unset)).to(_schema(series.sparkSession))


def _schema(spark):
    return spark.createDataFrame([], PARAMS).schema


def gathered(params: DataFrame) -> DataFrame:
    """One row for each series: its folds and their parameters, as the tasks that read its chunks need them."""
    one = F.struct("fold", "span", "until", "since", "skip_first", "skip_last", "cuts", "theta", "coef")
    return params.groupBy(SERIES).agg(F.sort_array(F.collect_list(one)).alias("folds"))


def read_chunk(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    lately = [c for c in BEFORE_FORECAST if c in batch.schema.names]
    return {c: get(c) for c in (*FIELDS, *FORECAST, *(f"before_{x}" for x in WEATHER), *lately)}


def with_forecast(fields: dict[str, np.ndarray], cutoff: int, bias: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Forecast weather where there is any from the cutoff on, in place of measured. ``bias``: for a kind of weather, what is taken from each
    hour after the cutoff."""
    out = dict(fields)
    for x in (*WEATHER, "gloom"):
        told = unbiased(fields[f"forecast_{x}"], fields["t"], cutoff, x, bias)
        out[x] = np.where((fields["t"] >= cutoff) & ~np.isnan(told), told, fields[x])
    if len(fields["t"]) > 1 and fields["t"][0] > cutoff:  # a horizon that began in the chunk before
        for x in WEATHER:
            lately, past = fields.get(f"before_forecast_{x}", ()), fields[f"before_{x}"].copy()
            if len(lately) and len(lately) <= len(past):
                at = fields["t"][0] - (fields["t"][1] - fields["t"][0]) * np.arange(len(lately), 0, -1)
                told = unbiased(lately, at, cutoff, x, bias)
                past[-len(lately) :] = np.where((at >= cutoff) & ~np.isnan(told), told, past[-len(lately) :])
            out[f"before_{x}"] = past
    return out


def unbiased(told: np.ndarray, t: np.ndarray, cutoff: int, kind: str, bias: dict[str, np.ndarray] | None) -> np.ndarray:
    """Forecasts less the bias of their hour after the cutoff; wind stays at or above 0. Rows before the cutoff or past the biases stay."""
    less = (bias or {}).get(kind)
    if less is None or not len(less):
        return told
    hour = ((t - cutoff) // 3600).astype(int)
    fixed = told - less[np.clip(hour, 0, len(less) - 1)]
    return np.where((hour >= 0) & (hour < len(less)), np.maximum(fixed, 0.0) if kind == "wind" else fixed, told)


def counted(rows: Rows, fold: dict, which: str) -> np.ndarray:
    """The rows that a fold's fit sees: known at its cutoff, in its window or a holiday's surroundings, not left out, of the stage's days."""
    f = rows.f
    seen = (f["t"] < fold["until"]) & ((f["t"] >= fold["since"]) | rows.has("context")) & ~((f["day"] >= fold["skip_first"]) & (f["day"] <= fold["skip_last"]))
    seen &= np.isfinite(f["load"]) & np.isfinite(f["temp"]) & np.isfinite(f["sun"]) & np.isfinite(f["wind"])
    return seen if which == "all" else seen & rows.has(which)


def design(rows: Rows, q: dict[str, float], coef: np.ndarray, moving: tuple[str, ...], responses: Responses) -> np.ndarray:
    """[base, heating, trend, cooling, generation, derivatives of the load by the moving shapes], and a last column for the target."""
    lay, k, trend, ramps = rows.layout, rows.k_shape(), rows.trend(), rows.ramps()
    heat, cool, sun = responses.heating(q), responses.cooling(q), responses.generation(q)
    x, s, p = np.empty((len(heat), lay.width + len(moving) + 1)), lay.slices, lay.width
    x[:, : s["heating"].start] = rows.base()
    np.multiply(k, heat[:, None], out=x[:, s["heating"]])
    np.multiply(trend, heat[:, None], out=x[:, s["trend"]])
    np.multiply(k, cool[:, None], out=x[:, s["cooling"]])
    np.multiply(ramps, -sun[:, None], out=x[:, s["pv"]])
    c = {name: coef[s[name]] for name in ("heating", "trend", "cooling", "pv")} if len(coef) and moving else None
    if c is not None:
        amplitude = {"heating": k @ c["heating"] + trend @ c["trend"], "cooling": k @ c["cooling"], "pv": -(ramps @ c["pv"])}
    for i, name in enumerate(moving):
        shape = SHAPES[NAMES.index(name)]
        delta = BUMP * (q[name] if name.startswith("tau") else shape.high - shape.low)
        other = q | {name: q[name] + delta}
        if c is None:
            x[:, p + i] = 0.0
        elif shape in C.HEATING_SHAPES:
            x[:, p + i] = amplitude["heating"] * (responses.heating(other) - heat) / delta
        elif shape in C.COOLING_SHAPES:
            x[:, p + i] = amplitude["cooling"] * (responses.cooling(other) - cool) / delta
        else:
            x[:, p + i] = amplitude["pv"] * (responses.generation(other) - sun) / delta
    x[:, -1] = rows.f["load"]
    return x


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """Moments of the rows, or the rows themselves where they are fewer numbers."""
    n, p = x.shape
    if n < p // 2:
        return 0, x.astype("<f8").tobytes()
    return 1, (x.T @ x)[np.triu_indices(p)].astype("<f8").tobytes()


def unpacked(kind: int, data: bytes, p: int) -> np.ndarray:
    values = np.frombuffer(data, "<f8")
    if kind == 0:
        x = values.reshape(-1, p)
        return x.T @ x
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = values
    return g + np.triu(g, 1).T


def moments(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, stage: Stage, by_chunk: int = 0) -> DataFrame:
    """Moments of each series, fold and segment (between the fold's cuts), a row for each task that saw some of it. With ``by_chunk``, more than
    the number of cuts, each chunk has moments of its own: its segments count from by_chunk times its number."""
    wanted = [SERIES, *FIELDS, *FORECAST, *(f"before_{x}" for x in WEATHER), *(["chunk"] if by_chunk else [])]
    rows = chunks.select(*wanted).join(gathered(params), SERIES).sortWithinPartitions(SERIES)
    names = [SERIES, "fold", "segment", "kind", "n", "n_mild", "data"]

    def out(series: str, sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        cols = [[series] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [sums[k][0] for k in keys], [sums[k][1] for k in keys], [sums[k][2] for k in keys], [sums[k][3] for k in keys]]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                series = batch.column(SERIES)[i].as_py()
                if series != current:
                    if sums:
                        yield out(current, _frozen(sums))
                    current, sums = series, {}
                first = by_chunk * batch.column("chunk")[i].as_py() if by_chunk else 0
                add(sums, read_chunk(batch, i), batch.column("folds")[i].as_py(), layout, step_hours, stage, first)
        if sums:
            yield out(current, _frozen(sums))

    return rows.mapInArrow(run, f"{SERIES} string, fold string, segment int, kind int, n long, n_mild long, data binary")


def _frozen(sums: dict) -> dict:
    """What a task sends of each fold and segment."""
    found = {}
    for key, (gram, x, n, mild) in sums.items():
        if gram is None:
            kind, data = packed(np.vstack(x))
        else:
            if x:
                some = np.vstack(x)
                gram = gram + some.T @ some
            kind, data = 1, gram[np.triu_indices(len(gram))].astype("<f8").tobytes()
        found[key] = (kind, n, mild, data)
    return found


def add(sums: dict, fields: dict, folds: list[dict], layout: Layout, step_hours: float, stage: Stage, first: int = 0) -> None:
    """Add a chunk's rows to the sums of each fold and segment (numbered from ``first``); what doesn't depend on a fold's span or shapes is built once."""
    kept: dict = {}
    responses = Responses(Rows(fields, layout), step_hours)
    for fold in folds:
        if fields["t"][0] >= fold["until"]:
            continue
        rows = Rows(fields, replace(layout, span_days=fold["span"]), kept)
        seen = counted(rows, fold, stage.rows)
        if not seen.any():
            continue
        x = design(rows, dict(zip(NAMES, fold["theta"], strict=True)), np.array(fold["coef"]), stage.shapes, responses)
        segment = np.searchsorted(np.array(fold["cuts"]), fields["t"], side="right") if fold["cuts"] else np.zeros(len(seen), int)
        mild = rows.has("mild")
        for k in np.unique(segment[seen]):
            picked = seen & (segment == k)
            gram, few, n, n_mild = sums.get((fold["fold"], first + int(k)), (None, [], 0, 0))
            block = x if picked.all() else x[picked]
            if len(block) + sum(map(len, few)) < x.shape[1] // 2:
                few = [*few, block.copy()]
            else:
                whole = np.vstack([*few, block]) if few else block
                gram, few = (whole.T @ whole if gram is None else gram + whole.T @ whole), []
            sums[fold["fold"], first + int(k)] = (gram, few, n + len(block), n_mild + int((mild & picked).sum()))


def solved(stage: Stage, lay: Layout, g: np.ndarray, n: int, n_mild: int, coef: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Coefficients (those of other blocks stay), sum of squares, and the moments S and g of the shapes' step. ``near``: coefficients of a
    similar fit, whose bounds are tried first."""
    p, d = lay.width, len(stage.shapes)
    if not len(coef):
        coef = np.zeros(p)
    names = list(stage.blocks or lay.sizes)
    free = np.concatenate([np.arange(lay.slices[b].start, lay.slices[b].stop) for b in names])
    fixed = np.zeros(p)
    if stage.blocks:
        fixed = coef.copy()
        fixed[free] = 0
    a, c = g[:p, :p], g[:p, -1] - g[:p, :p] @ fixed
    yy = g[-1, -1] - 2 * fixed @ g[:p, -1] + fixed @ a @ fixed
    penalty = lay.penalty(a, n, n_mild)
    if stage.rows == "mild":
        penalty = penalty + lay.anchor(a)
    sub = np.ix_(free, free)
    low = lay.lower()
    found = fixed.copy()
    found[free] = bounded(a[sub], c[free], low[free], penalty[sub], held=None if near is None or not len(near) else near[free] <= low[free])
    x = found[free]
    sse = max(yy - 2 * x @ c[free] + x @ a[sub] @ x, 0.0)
    if not d or not np.any(np.diag(g)[p : p + d] > 0):
        return found, sse, np.zeros((d, d)), np.zeros(d)
    inner = (a + penalty)[sub]
    used = np.flatnonzero((np.diag(inner) > 0) & ~((low[free] == 0) & (x <= 0)))
    inner = inner[np.ix_(used, used)]
    inner[np.diag_indices(len(used))] += 1e-9 * np.trace(inner) / len(used)
    cross = g[free[used], p : p + d]
    half = np.linalg.solve(inner, cross)
    right = g[p : p + d, -1] - g[p : p + d, :p] @ fixed
    return found, sse, g[p : p + d, p : p + d] - cross.T @ half, right - half.T @ c[free[used]]


def prior(theta: np.ndarray, n: int, moving: tuple[str, ...]) -> tuple[float, np.ndarray, np.ndarray]:
    """Cost of the priors, and what they add to the step's moments."""
    cost, s, g = 0.0, np.zeros(len(moving)), np.zeros(len(moving))
    for k, name in enumerate(moving):
        shape = next(x for x in SHAPES if x.name == name)
        if shape.prior:
            mean, sd = shape.prior
            weight = C.PRIOR_WEIGHT * n * C.PRIOR_RMSE**2 / sd**2
            gap = mean - theta[NAMES.index(name)]
            cost, s[k], g[k] = cost + weight * gap**2, weight, weight * gap
    return cost, s, g


def moved(theta: np.ndarray, s: np.ndarray, g: np.ndarray, n: int, moving: tuple[str, ...], damping: float) -> np.ndarray:
    """Shapes after a damped step, within the bounds and by no more than a quarter of their width."""
    at = [NAMES.index(x) for x in moving]
    low, width = np.array([SHAPES[i].low for i in at]), np.array([SHAPES[i].high - SHAPES[i].low for i in at])
    _, more, pull = prior(theta, n, moving)
    scaled = (s + np.diag(more)) * np.outer(width, width)
    scaled[np.diag_indices(len(at))] += damping * np.diag(scaled) + 1e-9 * np.trace(scaled) + 1e-300
    delta = width * np.clip(np.linalg.solve(scaled, (g + pull) * width), -0.25, 0.25)
    out = theta.copy()
    out[at] = np.clip(out[at] + delta, low, low + width)
    return out


def one_pass(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, stage: Stage, last: bool = False) -> DataFrame:
    """Evaluate the trial shapes of every series and fold, keep the better state, and put the next trial."""
    found = moments(chunks, params, layout, step_hours, stage)
    old = params.groupBy(SERIES, "fold").agg(F.first(F.struct(*[c for c in params.columns if c not in (SERIES, "fold")])).alias("p"))

    def finish(keys: tuple, sums: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(now):
            return pd.DataFrame()
        p = now["p"].iloc[0]
        p = p.asDict(recursive=True) if hasattr(p, "asDict") else dict(p)
        row = {SERIES: keys[0], "fold": keys[1], **p}
        if len(sums):
            lay = replace(layout, span_days=int(p["span"]))
            width = lay.width + len(stage.shapes) + 1
            g = sum(unpacked(k, b, width) for k, b in zip(sums["kind"], sums["data"], strict=True))
            n, n_mild = int(sums["n"].sum()), int(sums["n_mild"].sum())
            theta, coef = np.array(p["theta"], float), np.array(p["coef"], float)
            new, sse, s, right = solved(stage, lay, g, n, n_mild, coef, near=coef)
            cost = sse + prior(theta, n, stage.shapes)[0]
            here = {"theta": theta.tolist(), "coef": new.tolist(), "cost": float(cost), "rmse": float(np.sqrt(sse / max(n, 1))), "n": n, "s": s.ravel().tolist(), "g": right.tolist()}
            best, damping = p["best"], float(p["damping"])
            best = best.asDict() if hasattr(best, "asDict") else best
            better = best is None or not len(best["s"]) or cost <= best["cost"] or not np.any(np.array(best["g"]))
            damping = (max(damping / 4, 1e-4) if better else min(damping * 8, 1e4)) if stage.shapes else damping
            best = here if better else best
            trial, pull = np.array(best["theta"]), np.array(best["g"])
            if pull.any() and not last:
                trial = moved(trial, np.array(best["s"]).reshape(len(pull), -1), pull, n, stage.shapes, damping)
            row |= {"theta": trial.tolist(), "coef": list(best["coef"]), "rmse": best["rmse"], "n": int(best["n"]), "damping": damping, "best": best}
        return pd.DataFrame([row])

    return found.groupBy(SERIES, "fold").cogroup(old.groupBy(SERIES, "fold")).applyInPandas(finish, PARAMS)


def run_stages(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, stages: list[Stage]) -> DataFrame:
    """All stages of all series and folds, each from the state that the one before left."""
    now, path, spark = params, None, chunks.sparkSession
    for stage in stages:
        now = now.withColumns({"best": F.lit(None).cast(f"struct<{STATE}>"), "damping": F.lit(0.05)})
        for k in range(stage.passes):
            found, before = one_pass(chunks, now, layout, step_hours, stage, last=k + 1 == stage.passes), path
            path = written(found, "fit")
            now = spark.read.schema(found.schema).parquet(path)
            if before:
                dropped(spark, before)
        now = now.withColumn("theta", F.coalesce("best.theta", "theta"))
    return now


def pinned(params: DataFrame, pins: dict[str, float]) -> DataFrame:
    """Parameters with shapes set by hand; a pin may lie outside the bounds."""
    unknown = set(pins) - set(NAMES)
    if unknown:
        raise ValueError(f"not shapes: {sorted(unknown)}")
    fixed = F.create_map(*(x for n, v in pins.items() for x in (F.lit(NAMES.index(n)), F.lit(float(v))))) if pins else None
    return params if fixed is None else params.withColumn("theta", F.transform("theta", lambda x, i: F.coalesce(F.try_element_at(fixed, i), x)))


def joint(df: DataFrame, layout: Layout, step_hours: float, passes: int = 8, params: DataFrame | None = None, chunks: DataFrame | None = None, pins: dict[str, float] | None = None) -> DataFrame:
    """Parameters of each series (or fold, where ``params`` has several): shapes, coefficients, RMSE.

    ``df``: series_id, ts, load, weather and calendar columns, dark and gloom. From the starting shapes, all components at once.
    ``pins`` are shapes that stay at a value, which may lie outside the bounds.
    """
    chunks = chunked(df) if chunks is None else chunks
    now = pinned(start(chunks.select(SERIES).distinct(), layout) if params is None else params, pins or {})
    return run_stages(chunks, now, layout, step_hours, [without(Stage(passes=passes), pins or {})])


def without(stage: Stage, pins: dict[str, float]) -> Stage:
    return replace(stage, shapes=tuple(n for n in stage.shapes if n not in pins))


def from_scratch(df: DataFrame, layout: Layout, step_hours: float, passes: int = 8, params: DataFrame | None = None, chunks: DataFrame | None = None, pins: dict[str, float] | None = None) -> DataFrame:
    """The staged chain: base on mild days, heating on cold ones, cooling with generation, then the joint fit from what they found."""
    chunks = chunked(df) if chunks is None else chunks
    now = pinned(start(chunks.select(SERIES).distinct(), layout) if params is None else params, pins or {})
    return run_stages(chunks, now, layout, step_hours, [without(stage, pins or {}) for stage in staged(layout, passes)])


def linear(df: DataFrame, layout: Layout, step_hours: float, params: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Coefficients at given shapes: one pass."""
    chunks = chunked(df) if chunks is None else chunks
    return run_stages(chunks, params, layout, step_hours, [Stage(shapes=(), passes=1)])


def refits(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float) -> DataFrame:
    """Coefficients at given shapes for every cut of every fold, from one scan: moments are summed up to each cut.

    Gives the folds' parameters with ``until`` the cut and ``segment`` its number.
    """
    stage = Stage(shapes=(), passes=1)
    found = moments(chunks, params, layout, step_hours, stage)
    old = params.groupBy(SERIES, "fold").agg(F.first(F.struct("span", "theta", "cuts")).alias("p"))

    def finish(keys: tuple, sums: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(now) or not len(sums):
            return pd.DataFrame()
        p = now["p"].iloc[0]
        lay = replace(layout, span_days=int(p["span"]))
        g, n, n_mild, out, coef = np.zeros((lay.width + 1, lay.width + 1)), 0, 0, [], None
        for k, cut in enumerate(p["cuts"]):
            for part in sums[sums["segment"] == k].itertuples():
                g = g + unpacked(part.kind, part.data, lay.width + 1)
                n, n_mild = n + part.n, n_mild + part.n_mild
            if n:
                coef, sse, _, _ = solved(stage, lay, g, n, n_mild, np.zeros(0), near=coef)
                out.append({SERIES: keys[0], "fold": keys[1], "span": lay.span_days, "until": int(cut), "theta": list(p["theta"]), "coef": coef.tolist(), "rmse": float(np.sqrt(sse / n)), "n": n})
        return pd.DataFrame(out)

    schema = f"{SERIES} string, fold string, span int, until long, theta array<double>, coef array<double>, rmse double, n long"
    return found.groupBy(SERIES, "fold").cogroup(old.groupBy(SERIES, "fold")).applyInPandas(finish, schema)


def predicted_names(layout: Layout) -> list[str]:
    return [f"part_{b}" for b in layout.base_names] + ["base", "heating", "cooling", "pv", "model", "heating_shape", "pv_shape"]


def predict(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, ahead: bool = False, few_days: bool = False) -> DataFrame:
    """series_id, fold, ts, date_local, tod, daytype, load, temp, sun; the blocks of the base, base, heating, cooling, pv and their sum ``model``;
    heating_shape and pv_shape, the load that a unit of sensitivity or capacity makes.

    ``params``: series_id, fold, span, theta, coef. With ``ahead``, also until, first and last (days since 1970): only rows of those days,
    with forecast weather from ``until`` on; and with ``few_days``, for folds of few days each, a chunk meets only those with days in it.
    ``bias_`` and a kind of weather, where ``params`` has it: an array of what forecasts lose by the hour after ``until``.
    """
    names = predicted_names(layout)
    biased = [x for x in WEATHER if ahead and f"bias_{x}" in params.columns]
    extra = ["until", "first", "last", *(f"bias_{x}" for x in biased)] if ahead else []
    key = [SERIES, "chunk"] if few_days else [SERIES]
    if few_days:
        number = lambda day: F.floor(day / DAYS).cast("int")
        params = params.withColumn("chunk", F.explode(F.sequence(number(F.col("first") - 1), number(F.col("last") + 1))))
    own = params.groupBy(*key).agg(F.collect_list(F.struct("fold", "span", "theta", "coef", *extra)).alias("folds"))
    lately = BEFORE_FORECAST if ahead else ()
    rows = chunks.select(*key, *FIELDS, *FORECAST, *(f"before_{x}" for x in WEATHER), *lately).join(own, key)
    kept = ["tod", "load", "temp", "sun"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fields = read_chunk(batch, i)
                for fold in batch.column("folds")[i].as_py():
                    picked = (fields["day"] >= fold["first"]) & (fields["day"] <= fold["last"]) if ahead else np.ones(len(fields["t"]), bool)
                    if picked.any():
                        seen = with_forecast(fields, fold["until"], {x: np.array(fold[f"bias_{x}"]) for x in biased if fold[f"bias_{x}"]}) if ahead else fields
                        values = components(Rows(seen, replace(layout, span_days=fold["span"])), fold, step_hours)
                        table = [pa.array([batch.column(SERIES)[i].as_py()] * int(picked.sum())), pa.array([fold["fold"]] * int(picked.sum()))]
                        table += [pa.array(fields["t"][picked].astype(np.int64)), pa.array(fields["day"][picked].astype(np.int32)), pa.array(fields["daytype"][picked].astype(np.int32))]
                        table += [pa.array(np.asarray(x, float)[picked], from_pandas=True) for x in (fields["tod"], fields["load"], seen["temp"], seen["sun"], *(values[k] for k in names))]
                        yield pa.RecordBatch.from_arrays(table, names=[SERIES, "fold", "t", "day", "daytype", *kept, *names])

    schema = f"{SERIES} string, fold string, t long, day int, daytype int, " + ", ".join(f"{c} double" for c in (*kept, *names))
    found = rows.mapInArrow(run, schema)
    return found.select(SERIES, "fold", F.timestamp_seconds("t").alias("ts"), F.date_from_unix_date("day").alias("date_local"), "daytype", *kept, *names)


def components(rows: Rows, fold: dict, step_hours: float) -> dict[str, np.ndarray]:
    lay, coef, q = rows.layout, np.array(fold["coef"]), dict(zip(NAMES, fold["theta"], strict=True))
    s, r = lay.slices, Responses(rows, step_hours)
    out = {f"part_{n}": x @ coef[s[n]] for n, x in rows.base_blocks().items()}
    base = sum(out.values())
    k, capacity = rows.k_shape(), rows.ramps() @ coef[s["pv"]]
    heat, sun = r.heating(q), r.generation(q)
    heating = (k @ coef[s["heating"]] + rows.trend() @ coef[s["trend"]]) * heat
    cooling, pv = k @ coef[s["cooling"]] * r.cooling(q), capacity * sun
    return out | {"base": base, "heating": heating, "cooling": cooling, "pv": pv, "model": base + heating + cooling - pv, "heating_shape": heat, "pv_shape": sun}


def explained(predicted: DataFrame) -> DataFrame:
    """Eleven additive parts of the modelled load."""
    p = lambda *names: sum((F.col(f"part_{n}") for n in names), F.lit(0.0))
    return predicted.select(
        SERIES, "ts", p("level").alias("level"), p("dt0", "dt1", "dt2", "dt3").alias("profile"), p("holiday").alias("holidays"), p("morning").alias("morning"), p("bridge1", "bridge2").alias("bridges"),
        p("light").alias("light"), p("gloom").alias("gloom_load"), p("summer_work", "summer_off").alias("summer"), p(*(f"period_{x.name}" for x in C.PERIODS)).alias("special"), "heating", "cooling", (-F.col("pv")).alias("generation"), "model",
    )


#: Counterfactuals: sunshine, wind or inertia without a part in heating or cooling.
EFFECTS = (("a", 0.0, "heating"), ("b", 0.0, "heating"), ("w", 1.0, "heating"), ("a_c", 0.0, "cooling"), ("w_c", 1.0, "cooling"))


def weather_effects(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float) -> DataFrame:
    """What heating and cooling change if sunshine, wind or inertia played no part: all counterfactuals are folds of one prediction."""
    swapped = lambda i, v: F.transform("theta", lambda x, k: F.when(k == i, F.lit(v)).otherwise(x))
    cases = [F.struct(F.lit(n).alias("fold"), swapped(NAMES.index(n), v).alias("theta")) for n, v, _ in EFFECTS]
    all_cases = F.array(F.struct(F.lit("whole").alias("fold"), F.col("theta").alias("theta")), *cases)
    folds = params.select(SERIES, "span", "coef", F.inline(all_cases))
    told = predict(chunks, folds, layout, step_hours)
    whole = lambda c: F.max(F.when(F.col("fold") == "whole", F.col(c)))
    return told.groupBy(SERIES, "ts").agg(*((whole(c) - F.max(F.when(F.col("fold") == n, F.col(c)))).alias(f"effect_{n}") for n, _, c in EFFECTS))


def cleaned(predicted: DataFrame, normal: DataFrame) -> DataFrame:
    """Weather-cleaned load: without heating, cooling and generation; and with those of normal weather in their place."""
    n = normal.select(SERIES, "ts", (F.col("heating") + F.col("cooling") - F.col("pv")).alias("_n"))
    weather = F.col("heating") + F.col("cooling") - F.col("pv")
    return predicted.join(n, [SERIES, "ts"]).select(SERIES, "ts", "load", (F.col("load") - weather).alias("cleaned"), (F.col("load") - weather + F.col("_n")).alias("normalised"))


assert set(FLAGS) >= {"mild", "cold", "context"}
