"""Configuration of a weight-generation run as TOML, with the rules that hold between its parts."""

from __future__ import annotations

import tomllib
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path

CONVENTIONS = ("[-180,180)", "[0,360)")


class ConfigError(ValueError):
    """The configuration can't be run."""


def _one_of(where: str, value, allowed: tuple) -> None:
    if value not in allowed:
        raise ConfigError(f"{where} must be one of {list(allowed)}, not {value!r}")


def _either(where: str, obj, a: str, b: str) -> None:
    if (getattr(obj, a) is None) == (getattr(obj, b) is None):
        raise ConfigError(f"{where} needs exactly one of {a} and {b}")


@dataclass
class Project:
    name: str
    description: str | None = None


@dataclass
class Regions:
    id_fields: list[str]
    path: str | None = None
    table: str | None = None
    version: str | None = None
    keep: dict | None = None
    drop: dict | None = None
    on_invalid_geometry: str = "repair"
    on_null_geometry: str = "error"
    on_unknown_id: str = "error"

    def __post_init__(self):
        _either("regions", self, "path", "table")
        _one_of("regions.on_invalid_geometry", self.on_invalid_geometry, ("repair", "skip", "error"))
        for k in ("on_null_geometry", "on_unknown_id"):
            _one_of(f"regions.{k}", getattr(self, k), ("error", "skip"))
        if not self.id_fields:
            raise ConfigError("regions.id_fields is empty")


@dataclass
class Grid:
    mode: str
    resolution: float | None = None
    offset: str = "center"
    lon_convention: str = CONVENTIONS[0]
    path: str | None = None
    table: str | None = None

    def __post_init__(self):
        _one_of("grid.mode", self.mode, ("generate", "prebuilt"))
        _one_of("grid.offset", self.offset, ("center", "edge"))
        _one_of("grid.lon_convention", self.lon_convention, CONVENTIONS)
        if self.mode == "generate":
            if self.resolution is None or self.resolution <= 0:
                raise ConfigError("a generated grid needs a positive resolution")
            if self.path or self.table:
                raise ConfigError("a generated grid takes no path or table")
        else:
            if self.resolution is not None:
                raise ConfigError("a prebuilt grid takes no resolution")
            _either("grid", self, "path", "table")


@dataclass
class Source:
    path: str
    id_fields: list[str]
    version: str
    on_invalid_geometry: str = "repair"
    on_zero_overlap: str = "error"
    coverage_threshold: float = 0.999

    def __post_init__(self):
        _one_of("source.on_invalid_geometry", self.on_invalid_geometry, ("repair", "skip", "error"))
        _one_of("source.on_zero_overlap", self.on_zero_overlap, ("error", "skip"))
        if not 0 < self.coverage_threshold <= 1:
            raise ConfigError("source.coverage_threshold lies above 0 and up to 1")


@dataclass
class WeightEntry:
    name: str
    raster: str | None = None
    table: str | None = None
    resolution: float | None = None
    fallback: str | None = None
    kind: str = "point_sum"

    def __post_init__(self):
        if self.fallback is not None:
            _one_of(f"weights.{self.name}.fallback", self.fallback, ("area", "zero", "error", "nan"))
        _one_of(f"weights.{self.name}.kind", self.kind, ("point_sum", "area_weighted_sum"))
        if self.name == "area":
            if self.raster or self.table:
                raise ConfigError("the area weight takes no raster or table")
        else:
            _either(f"weights.{self.name}", self, "raster", "table")


@dataclass
class Output:
    dir: str
    format: str = "parquet"
    single: bool = False

    def __post_init__(self):
        _one_of("output.format", self.format, ("parquet", "csv", "both"))


@dataclass
class Validation:
    sum_tolerance: float = 1e-6
    mass_balance_tolerance: float = 1e-6


@dataclass
class Config:
    """One run: regions, a grid or polygon sources, weights, and where the result goes."""

    project: Project
    regions: Regions
    weights: list[WeightEntry]
    output: Output
    grid: Grid | None = None
    source: Source | None = None
    coverage: str = "exact_fraction"
    min_segment_area_m2: float = 1.0
    normalization: str = "per_destination"
    validation: Validation = field(default_factory=Validation)

    def __post_init__(self):
        if (self.grid is None) == (self.source is None):
            raise ConfigError("a run needs exactly one of [grid] and [source]")
        _one_of("coverage", self.coverage, ("exact_fraction", "pixel_centroid"))
        _one_of("normalization", self.normalization, ("per_destination", "per_source"))
        if self.min_segment_area_m2 < 0:
            raise ConfigError("min_segment_area_m2 can't be negative")
        names = [w.name for w in self.weights]
        if not names or len(set(names)) < len(names):
            raise ConfigError(f"weights need different names: {names}")
        if self.source is not None and self.regions.version is None:
            raise ConfigError("polygon sources need regions.version")
        if self.grid is not None and self.normalization != "per_destination":
            raise ConfigError("weights of grid cells are per_destination")
        if self.grid is not None and self.grid.mode == "prebuilt" and self.grid.lon_convention != CONVENTIONS[0]:
            raise ConfigError("a prebuilt grid has longitudes from -180")


PARTS = {"project": Project, "regions": Regions, "grid": Grid, "source": Source, "output": Output, "validation": Validation}


def _made(kind, spec: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(spec) - known:
        raise ConfigError(f"{where} has unknown keys {sorted(unknown)}; there are {sorted(known)}")
    needed = [f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING]
    if lost := [k for k in needed if k not in spec]:
        raise ConfigError(f"{where} lacks {lost}")
    return kind(**spec)


def resolved(path: str | None, folder: Path) -> str | None:
    """A relative path from a folder; URLs and absolute paths as they are."""
    return path if path is None or "://" in path or path.startswith("/") else str(folder / path)


def load(path: str) -> Config:
    """The configuration of a TOML file; unknown keys raise, relative paths count from its folder."""
    folder = Path(path).resolve().parent
    spec = tomllib.loads(Path(path).read_text())
    for part, key in (("regions", "path"), ("grid", "path"), ("source", "path"), ("output", "dir")):
        if key in spec.get(part, {}):
            spec[part][key] = resolved(spec[part][key], folder)
    for w in spec.get("weights", []):
        w["raster"] = resolved(w.get("raster"), folder)
    for part, kind in PARTS.items():
        if part in spec:
            spec[part] = _made(kind, spec[part], part)
    spec["weights"] = [_made(WeightEntry, w, f"weights[{i}]") for i, w in enumerate(spec.get("weights", []))]
    return _made(Config, spec, "the configuration")
