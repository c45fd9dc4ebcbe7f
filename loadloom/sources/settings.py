"""Configuration and shown parameters as YAML; bounded files, read and written on the driver."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import yaml

from loadloom import config as C
from loadloom.config import Shape

SECTIONS = {"heating": C.HEATING_SHAPES, "cooling": C.COOLING_SHAPES, "pv": C.PV_SHAPES}


def read_yaml(path: str) -> dict:
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path}: sections expected")
    return found or {}


def shapes(path: str) -> dict[str, tuple[Shape, ...]]:
    """The shapes of each section with the bounds, start, prior and fixed value that the file gives; others stay.

    A file holds sections (heating, cooling, pv) of shapes, each with bounds [low, high], start, prior [mean, sd] and fixed.
    """
    told, out = read_yaml(path), {}
    if unknown := set(told) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    for section, known in SECTIONS.items():
        given = told.get(section) or {}
        if unknown := set(given) - {s.name for s in known}:
            raise ValueError(f"unknown shapes in {section}: {sorted(unknown)}")
        out[section] = tuple(_changed(s, given.get(s.name) or {}) for s in known)
    return out


def _changed(shape: Shape, given: dict) -> Shape:
    low, high = given.get("bounds", (shape.low, shape.high))
    prior = given.get("prior", shape.prior)
    found = replace(shape, low=float(low), high=float(high), start=float(given.get("start", shape.start)), prior=tuple(map(float, prior)) if prior else None, fixed=given.get("fixed", shape.fixed))
    if not found.low <= found.start <= found.high:
        raise ValueError(f"{shape.name}: start {found.start} is not within its bounds")
    return found


def write_shown(theta: dict[str, float], path: str, derived: dict[str, float] | None = None, digits: int = 6) -> None:
    """Shapes by section, and derived quantities, at ``digits`` significant digits, for people to read and edit."""
    short = lambda v: float(f"{v:.{digits}g}")
    shown = {section: {s.name: short(theta[s.name]) for s in known if s.name in theta} for section, known in SECTIONS.items()}
    if derived:
        shown["derived"] = {k: short(v) for k, v in derived.items()}
    Path(path).write_text(yaml.safe_dump(shown, sort_keys=False), encoding="utf-8")


def read_shown(path: str) -> dict[str, float]:
    """The shapes of a shown file; derived quantities aren't read back."""
    told = read_yaml(path)
    return {name: float(v) for section in SECTIONS for name, v in (told.get(section) or {}).items()}
