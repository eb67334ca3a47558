"""From polygons to weights: segments, raw measures, fallbacks, checks, and an artifact with its account."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, normalize, validate, zonal
from ..operators import grid as gr
from ..operators import polygons as pg
from .schema import GRID_CELLS, OutputSchema, SourceUnits, WeightsArtifact

CELL = ["cell_ix", "cell_iy"]


class Backend(Protocol):
    """What makes weights from a configuration; the command line has the one over Spark."""

    def compute(self, config, test_mode: bool = False) -> WeightsArtifact: ...


@dataclass
class Weight:
    """A weight by its name: `area`, or the sum of a raster (px, py, value) on `grid`. fallback None means area, by default."""

    name: str
    raster: DataFrame | None = None
    grid: gr.GridSpec | None = None
    kind: str = "point_sum"
    fallback: str | None = None

    def __post_init__(self):
        if self.name == "area" and self.raster is not None:
            raise ValueError("the area weight takes no raster")
        if self.name != "area" and (self.raster is None or self.grid is None):
            raise ValueError(f"the weight {self.name!r} needs a raster and its grid")


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df written to a folder and read again, or without one kept by Spark on disk, so that its geometry is worked out once."""
    if folder is None:
        return df.persist(StorageLevel.DISK_ONLY)
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _prepared(regions: DataFrame, ids: list[str], invalid: str, null: str, requested: DataFrame | None, unknown: str, what: str) -> tuple[DataFrame, dict]:
    """Polygons by policy, and an account of what was repaired or left out."""
    if lost := [c for c in (*ids, "geometry") if c not in regions.columns]:
        raise ValueError(f"{what} lack columns {lost}; they have {regions.columns}")
    account: dict = {}
    if requested is not None:
        found = compare.reconciled(requested, regions, ids).collect()
        for status, policy in (("unknown", unknown), ("null_geometry", null)):
            some = [tuple(r)[:-1] for r in found if r["status"] == status]
            if some and policy == "error":
                raise ValueError(f"{what}: requested ids that are {status}, such as {some[:5]}")
            account[f"{status}_{what}"] = some[:500]
        regions = regions.join(requested.select(*ids).distinct(), ids, "left_semi")
    good, states = pg.mended(regions.select(*ids, "geometry"), ids, invalid)
    for r in states.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ids)).alias("first")).collect():
        if r["status"] in ("null", "empty") and null == "error":
            raise ValueError(f"{what}: {r['n']} {r['status']} geometries, such as {tuple(r['first'])}")
        account[f"{r['status']}_{what}"] = {"n": r["n"], "such_as": list(r["first"])}
    return good, account


def _weighed(segments: DataFrame, ids: list[str], keys: list[str], weights: list[Weight], normalization: str, coverage: str, meta: list[str]) -> tuple[DataFrame, dict]:
    """The area spine with every weight, and the methods of their groups."""
    group = ids if normalization == "per_destination" else keys
    rows = [*ids, *keys]
    spine = normalize.native_weights(segments.select(*rows, *meta, "area_raw"), group, "area", "area_raw")
    counts = {}
    for w in weights:
        if w.name == "area":
            continue
        raw = zonal.zonal_sums(segments, rows, w.raster, w.grid, coverage=coverage, kind=w.kind)
        spine = normalize.with_fallback(spine, raw, rows, group, w.name, w.fallback or "area", area="areawt")
    for w in weights:
        counts[w.name] = {r["method"]: r["n"] for r in normalize.method_counts(spine, group, w.name).collect()}
        if w.fallback is None and w.name != "area" and (n := sum(v for k, v in counts[w.name].items() if k != "native")) >= max(5, int(0.05 * sum(counts[w.name].values()))):
            warnings.warn(f"{w.name}: {n} groups fell back to area, which was not chosen; state fallback", stacklevel=3)
    return spine, counts


def _checked_weights(weights: list[Weight]) -> None:
    names = [w.name for w in weights]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"weights need different names: {names}")


def weights_on_grid(
    regions: DataFrame, ids: list[str], grid: gr.GridSpec, weights: list[Weight], *, coverage: str = "exact_fraction", min_segment_m2: float = 0.0, regions_version: str | None = None, source_version: str | None = None,
    on_invalid: str = "repair", on_null: str = "error", requested: DataFrame | None = None, on_unknown: str = "error", tolerance: float = 1e-6, persist: str | None = None,
) -> WeightsArtifact:
    """Weights of grid cells in each region (per destination), from regions(ids, geometry).

    Regions without any cell get the cell of a point inside them (method nearest_cell). With
    `persist`, a folder, segments and weights are written there, else Spark keeps them on disk. The result is checked: indices and coordinates within the grid, no repeated keys,
    weights that sum to one.
    """
    _checked_weights(weights)
    good, account = _prepared(regions, ids, on_invalid, on_null, requested, on_unknown, "regions")
    # the hemispheres of a region may hold one cell in two pieces
    raw = pg.cells(good, ids, grid, shapes=True).where("area_raw > 0")
    raw = _kept(raw.withColumn("cell_lon", grid.lon(F.col("cell_ix"))).withColumn("cell_lat", grid.lat(F.col("cell_iy"))), persist, "segments")
    segments, lost = gr.large_segments(raw, ids, min_segment_m2)
    frame, counts = _weighed(segments, ids, CELL, weights, "per_destination", coverage, ["cell_lon", "cell_lat"])
    schema = OutputSchema(tuple(ids), tuple(w.name for w in weights), GRID_CELLS, "per_destination")
    frame = frame.select(*(F.col(c) for c in schema.columns if c in frame.columns))
    points = pg.inner_points(good, ids)
    frame = frame.unionByName(gr.nearest_cell_rows(points, frame, grid, ids, [w.name for w in weights])).select(*schema.columns)
    frame = _kept(frame, persist, "frame")
    validate.enforce(validate.grid_problems(frame, grid.n_ix, grid.n_iy, ids, grid.west), "weights on the grid")
    if bad := validate.sum_to_one(frame, schema, tolerance).limit(5).collect():
        raise ValueError(f"weights that don't sum to one: {[tuple(r) for r in bad]}")
    small = lost.agg(F.sum("dropped"), F.max("discarded_share")).first()
    account |= {"fallback_counts": counts, "min_segment_area": {"threshold_m2": min_segment_m2, "dropped": small[0] or 0, "max_discarded_share": small[1] or 0.0}, "coverage": coverage}
    return WeightsArtifact(frame, schema, regions_version, source_version, None, account)


def weights_on_polygons(
    regions: DataFrame, ids: list[str], sources: DataFrame, source_ids: list[str], weights: list[Weight], *, normalization: str = "per_destination", regions_version: str, source_version: str, coverage: str = "exact_fraction", min_segment_m2: float = 1.0,
    on_invalid: str = "repair", on_null: str = "error", on_zero_overlap: str = "error", coverage_threshold: float = 0.999, tolerance: float = 1e-6, bin_degrees: float = 1.0, persist: str | None = None,
) -> WeightsArtifact:
    """Weights of source polygons in regions, in either direction.

    Sources that overlap no region raise or are skipped and listed. Sources of which the
    regions cover less than coverage_threshold are counted as partly covered, which
    application refuses unless told otherwise.
    """
    _checked_weights(weights)
    if clash := set(ids) & set(source_ids):
        raise ValueError(f"regions and sources both name an id {sorted(clash)}")
    if not regions_version or not source_version:
        raise ValueError("both versions have to be stated")
    good, account = _prepared(regions, ids, on_invalid, on_null, None, "error", "regions")
    units, more = _prepared(sources, source_ids, on_invalid, on_null, None, "error", "sources")
    account |= more
    for what, df, names in (("regions", good, ids), ("sources", units, source_ids)):
        if near := [r.asDict() for r in pg.domain_edge(df, names, what).limit(500).collect()]:
            account[f"near_domain_edge_{what}"] = near
    raw = _kept(pg.overlay(good, ids, units, source_ids, bin_degrees=bin_degrees, shapes=True), persist, "segments")
    segments, lost = gr.large_segments(raw, source_ids, min_segment_m2)
    none = units.select(*source_ids).join(segments.select(*source_ids).distinct(), source_ids, "left_anti")
    n_none, such = none.count(), [list(r) for r in none.limit(500).collect()]
    if n_none and on_zero_overlap == "error":
        raise ValueError(f"{n_none} sources overlap no region, such as {such[:10]}; on_zero_overlap='skip' goes on")
    frame, counts = _weighed(segments, ids, source_ids, weights, normalization, coverage, [])
    schema = OutputSchema(tuple(ids), tuple(w.name for w in weights), SourceUnits(tuple(source_ids)), normalization)
    frame = frame.select(*schema.columns)
    frame = _kept(frame, persist, "frame")
    present = units.join(none, source_ids, "left_anti")
    validate.enforce(validate.polygon_problems(frame, schema, present), "weights on polygons")
    if bad := validate.sum_to_one(frame, schema, tolerance).limit(5).collect():
        raise ValueError(f"weights that don't sum to one: {[tuple(r) for r in bad]}")
    whole = pg.described(present.select(*source_ids, "geometry")).select(*source_ids, F.col("geodesic_area").alias("area"))
    partial = gr.covered_share(segments, whole, source_ids, coverage_threshold)
    n_partial = partial.count()
    empty = good.select(*ids).join(frame.select(*ids).distinct(), ids, "left_anti")
    small = lost.agg(F.sum("dropped"), F.max("discarded_share")).first()
    account |= {
        "fallback_counts": counts, "zero_overlap_count": n_none, "zero_overlap_source_units": such, "empty_region_count": empty.count(), "empty_regions": [list(r) for r in empty.limit(500).collect()], "coverage": coverage,
        "partial_coverage_units": {"threshold": coverage_threshold, "count": n_partial, "units": [r.asDict() for r in partial.orderBy("share", *source_ids).limit(500).collect()]},
        "min_segment_area": {"threshold_m2": min_segment_m2, "dropped": small[0] or 0, "max_discarded_share": small[1] or 0.0},
    }
    return WeightsArtifact(frame, schema, regions_version, source_version, n_partial or None, account)
