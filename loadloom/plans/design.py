"""The additive model: layout of its coefficients, its design and its responses, built on numpy arrays inside tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.functions import arrays as A
from loadloom.functions.basis import evenly, level_knots

SHAPES = (*C.HEATING_SHAPES, *C.COOLING_SHAPES, *C.PV_SHAPES)
NAMES = [s.name for s in SHAPES]


class _Signals(dict):
    """What the recursive filters smooth: temperature, sunshine, and wind that cools a heated house. Columns can only be made with a session, so they are made when asked for."""

    def __missing__(self, name: str) -> Column:
        if name == "wind":
            return F.col("wind") * F.greatest(C.HEATING["inside"] - F.col("temp"), F.lit(0.0))
        return F.col(name)


SIGNALS = _Signals()


def star(mode: str, a: float | Column, b: float | Column, w: float | Column, tail: str = "") -> Column:
    """Temperature felt by the building: a share of the present one and the rest of its past; ``mode`` h or c names the filters."""
    lit = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    a, b, w = lit(a), lit(b), lit(w)
    now = SIGNALS["temp"] + a * SIGNALS["sun"] - b * SIGNALS["wind"]
    past = F.col(f"temp_{mode}{tail}") + a * F.col(f"sun_{mode}{tail}") - b * F.col(f"wind_{mode}{tail}")
    return w * now + (1 - w) * past


@dataclass(frozen=True)
class Layout:
    """Names, lengths and order of the coefficient blocks for a history of ``span_days`` from ``first``."""

    first: str
    span_days: int

    @property
    def n_ramps(self) -> int:
        return max(int((self.span_days - C.PV["knot_days"]) / C.PV["knot_days"] + 1e-9), 0)

    @cached_property
    def sizes(self) -> dict[str, int]:
        from loadloom.operators.calendar import summer_length

        kp, kh, kb = C.BASE["profile"], C.BASE["holiday"], C.BASE["bridge"]
        n_summer = len(evenly(0.0, float(summer_length()), C.SUMMER_KNOT)) - 2
        n = {"level": len(level_knots(self.span_days)) + 2, "dt0": 2 * kp} | {f"dt{k}": 1 + 2 * kp for k in (1, 2, 3)}
        n |= {"holiday": 1 + 2 * kh, "morning": int(C.BASE["night_end"] / C.BASE["night_knot"] + 1e-9) + 1, "bridge1": 1 + 2 * kb, "bridge2": 1 + 2 * kb}
        n |= {"light": sum(len(evenly(a, b, C.LIGHT_KNOT)) - 2 for a, b in C.LIGHT_WINDOWS), "gloom": len(evenly(*C.GLOOM_WINDOW, C.GLOOM_KNOT)) - 2}
        n |= {"summer_work": n_summer * (1 + 2 * C.SUMMER_HARMONICS), "summer_off": n_summer} | {f"period_{p.name}": 1 + 2 * p.harmonics for p in C.PERIODS}
        k = 1 + 2 * C.HEATING["harmonics"] + 3 + 2 * C.HEATING["off_harmonics"]
        return n | {"heating": k, "trend": (1 + 2 * C.HEATING["trend_harmonics"]) * self.n_ramps, "cooling": k, "pv": 1 + self.n_ramps}

    @cached_property
    def slices(self) -> dict[str, slice]:
        out, at = {}, 0
        for name, n in self.sizes.items():
            out[name], at = slice(at, at + n), at + n
        return out

    @property
    def base_names(self) -> list[str]:
        return list(self.sizes)[:-4]

    @property
    def width(self) -> int:
        return sum(self.sizes.values())

    def lower(self) -> np.ndarray:
        """Lower bounds: lighting, gloom and solar capacity can't be negative."""
        low = np.full(self.width, -np.inf)
        for name in ("light", "gloom", "pv"):
            low[self.slices[name]] = 0.0
        return low

    def penalty(self, gram: np.ndarray, n: int, n_mild: int) -> np.ndarray:
        """Smoothness of the level (second differences), and first differences of the increments of capacity and heating trend. The level's
        weight is that of the fit on ``n_mild`` mild rows, rescaled to ``n`` rows."""
        s = self.slices
        out = np.zeros((self.width, self.width))
        d2 = np.diff(np.eye(self.sizes["level"]), 2, axis=0)
        out[s["level"], s["level"]] = C.BASE["smooth"] * n / max(n_mild, 1) * (d2.T @ d2)
        energy = np.diag(gram)
        size = self.n_ramps
        for name, blocks, skip, weight in (("pv", 1, 1, C.PV["penalty"]), ("trend", 1 + 2 * C.HEATING["trend_harmonics"], 0, C.HEATING["trend_penalty"])):
            if size < 2:
                continue
            d1 = np.diff(np.eye(size), axis=0)
            first = s[name].start + skip
            mean = energy[first : first + blocks * size].mean()
            for k in range(blocks):
                b = slice(first + k * size, first + (k + 1) * size)
                out[b, b] += weight * mean * (d1.T @ d1)
        return out

    def anchor(self, gram: np.ndarray) -> np.ndarray:
        """The base fit's ridge on what mild days determine badly: lighting, gloom and both summer blocks."""
        out, weight = np.zeros(self.width), C.BASE["anchor"] * np.trace(gram[: self.slices["heating"].start, : self.slices["heating"].start]) / self.slices["heating"].start
        for name in ("light", "gloom", "summer_work", "summer_off"):
            out[self.slices[name]] = weight
        return np.diag(out)


class Rows:
    """The rows of one chunk as arrays; see ``plans.chunks`` for the fields. ``before`` rows of weather precede them.

    ``kept`` holds what doesn't depend on the layout's span, for the folds of a chunk that differ in it.
    """

    def __init__(self, fields: dict[str, np.ndarray], layout: Layout, kept: dict | None = None):
        self.f, self.layout, self.kept = fields, layout, {} if kept is None else kept
        first = np.datetime64(layout.first, "D").astype(int)
        self.days = fields["day"] - first + fields["tod"] / 24
        self.off = fields["daytype"] >= 2

    def by_tod(self, basis) -> np.ndarray:
        """A basis of the time of day, evaluated once for each distinct one."""
        tod, place = np.unique(self.f["tod"], return_inverse=True)
        return basis(tod)[place]

    def has(self, flag: str) -> np.ndarray:
        return (self.f["flags"] >> FLAGS.index(flag) & 1).astype(bool)

    def once(self, name: str, make) -> np.ndarray | dict:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def base_blocks(self) -> dict[str, np.ndarray]:
        return {"level": A.level_basis(self.days, self.layout.span_days)} | self.once("blocks", self._fixed_blocks)

    def base(self) -> np.ndarray:
        """All blocks of the base side by side."""
        return np.hstack([A.level_basis(self.days, self.layout.span_days), self.once("fixed", lambda: np.hstack(list(self.once("blocks", self._fixed_blocks).values())))])

    def _fixed_blocks(self) -> dict[str, np.ndarray]:
        f, kp, kh, kb = self.f, C.BASE["profile"], C.BASE["holiday"], C.BASE["bridge"]
        waves = self.by_tod(lambda t: A.fourier(t, kp))
        ones = np.ones((len(waves), 1))
        const = lambda k: np.hstack([ones, waves[:, :k], waves[:, kp : kp + k]])
        where = lambda cond, arr: arr * np.asarray(cond)[:, None]
        working, bridge = ~self.off, self.has("bridge")
        out = {"dt0": waves}
        full = const(kp)
        for k in (1, 2, 3):
            out[f"dt{k}"] = where(f["daytype"] == k, full)
        out["holiday"] = where(self.has("holiday"), const(kh))
        out["morning"] = where(self.has("after_off") & working & ~bridge, self.by_tod(A.night_basis))
        for n in (1, 2):
            out[f"bridge{n}"] = where(bridge & (f["periods"] == 0) & (f["bridge_len"] == n), const(kb))
        out["light"] = where(f["dark"], self.by_tod(A.light_basis))
        out["gloom"] = where(f["gloom"], self.by_tod(lambda t: A.window_basis(t, *C.GLOOM_WINDOW, C.GLOOM_KNOT)))
        from loadloom.operators.calendar import summer_length

        position = np.where(f["summer_day"] >= 0, f["summer_day"] + f["tod"] / 24, -1.0)
        summer = A.window_basis(position, 0.0, float(summer_length()), C.SUMMER_KNOT)
        inside = position >= 0
        out["summer_work"] = where(working & inside, A.row_product(summer, const(C.SUMMER_HARMONICS)))
        out["summer_off"] = where(~working & inside, summer)
        for i, p in enumerate(C.PERIODS):
            out[f"period_{p.name}"] = where(f["periods"] >> i & 1, const(p.harmonics))
        return out

    def k_shape(self) -> np.ndarray:
        """Daily shape of a response, offsets of the day roles, and the shape's change on days off."""
        return self.once("k_shape", self._k_shape)

    def _k_shape(self) -> np.ndarray:
        waves = self.by_tod(lambda t: A.fourier(t, C.HEATING["harmonics"]))
        changed = self.by_tod(lambda t: A.fourier(t, C.HEATING["off_harmonics"])) * self.off[:, None]
        roles = np.column_stack([self.f["daytype"] == d for d in (1, 2, 3)])
        return np.hstack([np.ones((len(waves), 1)), waves, roles, changed])

    def ramps(self) -> np.ndarray:
        return A.ramps(self.days, self.layout.span_days, self.layout.n_ramps)

    def trend(self) -> np.ndarray:
        waves = self.once("trend_waves", lambda: self.by_tod(lambda t: A.fourier(t, C.HEATING["trend_harmonics"])))
        return A.row_product(np.hstack([np.ones((len(waves), 1)), waves]), self.ramps()[:, 1:])

    def signals(self) -> dict[str, np.ndarray]:
        """What the filters smooth, with the rows before the chunk."""
        whole = {x: np.concatenate([self.f[f"before_{x}"], self.f[x]]) for x in ("temp", "sun", "wind")}
        return whole | {"wind": whole["wind"] * np.maximum(C.HEATING["inside"] - whole["temp"], 0.0)}


class Responses:
    """Sizes of heating and cooling at given shapes; filters are kept, as derivatives ask for the same ones again."""

    def __init__(self, rows: Rows, step_hours: float):
        self.rows, self.step, self.x, self.kept = rows, step_hours, rows.signals(), {}
        self.n = len(rows.f["temp"])

    def past(self, name: str, tau: float) -> np.ndarray:
        if (name, tau) not in self.kept:
            self.kept[name, tau] = A.smoothed(self.x[name], float(np.exp(-self.step / tau)))[-self.n :]
        return self.kept[name, tau]

    def felt(self, a: float, b: float, w: float, tau: float) -> np.ndarray:
        now, past = ({x: self.x[x][-self.n :] for x in self.x}, {x: self.past(x, tau) for x in ("temp", "sun", "wind")})
        return sum(share * (v["temp"] + a * v["sun"] - b * v["wind"]) for share, v in ((w, now), (1 - w, past)))

    def heating(self, q: dict[str, float]) -> np.ndarray:
        felt = self.felt(q["a"], q["b"], q["w"], q["tau"])
        return A.softplus(q["t_b"] - felt, q["s"]) / np.maximum(1 + q["alpha"] * self.rows.f["temp"], C.HEATING["cop_floor"])

    def cooling(self, q: dict[str, float]) -> np.ndarray:
        felt = self.felt(q["a_c"], 0.0, q["w_c"], q["tau_c"])
        return A.softplus(felt - q["t_bc"], q["s_c"]) / np.maximum(1 - q["alpha_c"] * (self.rows.f["temp"] - C.COOLING["reference"]), C.COOLING["eer_floor"])

    def generation(self, q: dict[str, float]) -> np.ndarray:
        """Sunshine by the modules' efficiency; capacity times this is what the load lacks."""
        return self.rows.f["sun"] * (1 - q["gamma"] * (self.rows.f["temp"] - C.PV["reference"]))


#: Bits of a chunk's ``flags``.
FLAGS = ("holiday", "after_off", "bridge", "context", "mild", "cold", "irregular")
