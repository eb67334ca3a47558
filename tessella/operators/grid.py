"""Regular grids as column expressions: cells of points, points of cells, boxes on cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import sum0, value


@dataclass(frozen=True)
class GridSpec:
    """A global lon/lat grid. offset edge: indices count from lines between cells; center: points on the origin are cell centres."""

    resolution: float
    offset: str = "edge"
    west: float = -180.0

    def __post_init__(self):
        for span in (360, 180):
            n = span / self.resolution
            if abs(n - round(n)) > 1e-9:
                raise ValueError(f"a resolution of {self.resolution} doesn't tile {span} degrees")

    @property
    def n_ix(self) -> int:
        return round(360 / self.resolution)

    @property
    def n_iy(self) -> int:
        return round(180 / self.resolution)

    @property
    def half(self) -> float:
        return 0.0 if self.offset == "edge" else 0.5

    def index(self, c: Column, origin: float) -> Column:
        """Index of the cell of a coordinate; a point on a line belongs to the upper cell."""
        return F.floor((c - origin) / self.resolution + self.half).cast("long")

    def ix(self, lon: Column) -> Column:
        """Column of a longitude, wrapped around the globe."""
        return F.pmod(self.index(lon, self.west), F.lit(self.n_ix)).cast("long")

    def iy(self, lat: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.n_iy - 1), self.index(lat, -90.0))).cast("long")

    def lon(self, ix: Column) -> Column:
        return (ix + (0.5 - self.half)) * self.resolution + self.west

    def lat(self, iy: Column) -> Column:
        return (iy + (0.5 - self.half)) * self.resolution - 90.0

    def edges(self, i: Column, origin: float) -> tuple[Column, Column]:
        low = (i - self.half) * self.resolution + origin
        return low, low + self.resolution

    def index_range(self, lo: Column, hi: Column, origin: float, n: int) -> tuple[Column, Column]:
        """First and last index that an interval meets, clipped to the grid, never wrapped."""
        a = F.greatest(F.lit(0), self.index(lo, origin))
        return a.cast("long"), F.least(F.lit(n - 1), self.index(hi, origin)).cast("long")


def binned(points: DataFrame, grid: GridSpec, lon: str = "lon", lat: str = "lat", value_col: str = "value") -> DataFrame:
    """(cell_ix, cell_iy, raw): points summed by cell."""
    return points.groupBy(grid.ix(F.col(lon)).alias("cell_ix"), grid.iy(F.col(lat)).alias("cell_iy")).agg(sum0(value(value_col)).alias("raw"))


def box_cells(boxes: DataFrame, grid: GridSpec, ids: list[str]) -> DataFrame:
    """(ids, cell_ix, cell_iy, cell_lon, cell_lat, fraction, planar_area): the overlap of boxes (x0, y0, x1, y1) with cells, touching excluded; fraction is of the cell. A box whose sides are swapped raises."""
    swapped = F.raise_error(F.lit("a box has no inside: x1 < x0 or y1 < y0"))
    boxes = boxes.withColumn("x1", F.when(F.col("x1") < F.col("x0"), swapped).when(F.col("y1") < F.col("y0"), swapped).otherwise(F.col("x1")))
    ax, bx = grid.index_range(F.col("x0"), F.col("x1"), grid.west, grid.n_ix)
    ay, by = grid.index_range(F.col("y0"), F.col("y1"), -90.0, grid.n_iy)
    cells = boxes.withColumn("cell_ix", F.explode(F.sequence(ax, F.greatest(ax, bx)))).withColumn("cell_iy", F.explode(F.sequence(ay, F.greatest(ay, by))))
    (l, r), (b, t) = grid.edges(F.col("cell_ix"), grid.west), grid.edges(F.col("cell_iy"), -90.0)
    w = F.greatest(F.lit(0.0), F.least(F.col("x1"), r) - F.greatest(F.col("x0"), l))
    h = F.greatest(F.lit(0.0), F.least(F.col("y1"), t) - F.greatest(F.col("y0"), b))
    out = cells.withColumn("planar_area", w * h).where("planar_area > 0")
    return out.select(*ids, "cell_ix", "cell_iy", grid.lon(F.col("cell_ix")).alias("cell_lon"), grid.lat(F.col("cell_iy")).alias("cell_lat"), (F.col("planar_area") / grid.resolution**2).alias("fraction"), "planar_area")


def zonal_exact(segments: DataFrame, cells: DataFrame, ids: list[str], value_col: str = "raw") -> DataFrame:
    """(ids, raw): cell values by the covered fraction; cells without a value count 0."""
    joined = segments.join(cells, ["cell_ix", "cell_iy"], "left")
    return joined.groupBy(*ids).agg(sum0(value(value_col) * F.col("fraction")).alias("raw"))


def zonal_centroid(boxes: DataFrame, points: DataFrame, grid: GridSpec, ids: list[str]) -> DataFrame:
    """(ids, raw): values of the points (lon, lat, value) strictly inside each box. Boxes and points meet by cell, so no pair of others is formed."""
    tiles = box_cells(boxes, grid, [*ids, "x0", "y0", "x1", "y1"]).select(*ids, "x0", "y0", "x1", "y1", "cell_ix", "cell_iy")
    located = points.withColumn("cell_ix", grid.ix(F.col("lon"))).withColumn("cell_iy", grid.iy(F.col("lat")))
    inside = tiles.join(located, ["cell_ix", "cell_iy"]).where("lon > x0 AND lon < x1 AND lat > y0 AND lat < y1").groupBy(*ids).agg(F.sum(value("value")).alias("_s"))
    return boxes.select(*ids).join(inside, ids, "left").select(*ids, F.coalesce("_s", F.lit(0.0)).alias("raw"))


def nearest_cell_rows(points: DataFrame, frame: DataFrame, grid: GridSpec, ids: list[str], names: list[str]) -> DataFrame:
    """Rows for regions that the weights lack: the cell of a point inside (lon, lat), weight 1, raw 0, method nearest_cell. A point outside the grid raises when the rows are read."""
    missing = points.join(frame.select(*ids).distinct(), ids, "left_anti")
    inside = lambda i, n: F.when((i >= 0) & (i < n), i).otherwise(F.raise_error(F.lit("a region's point lies outside the grid")))
    ix, iy = inside(grid.index(F.col("lon"), grid.west), grid.n_ix), inside(grid.index(F.col("lat"), -90.0), grid.n_iy)
    cells = missing.select(*ids, ix.alias("cell_ix"), iy.alias("cell_iy")).withColumn("cell_lon", grid.lon(F.col("cell_ix"))).withColumn("cell_lat", grid.lat(F.col("cell_iy")))
    extra = [x for n in names for x in (F.lit(1.0).alias(f"{n}wt"), F.lit(0.0).alias(f"{n}_raw"), F.lit("nearest_cell").alias(f"{n}_method"))]
    return cells.select(*ids, "cell_ix", "cell_iy", "cell_lon", "cell_lat", *extra)


def cell_areas(segments: DataFrame, ids: list[str], area: str = "area_raw") -> DataFrame:
    """(ids, cell_ix, cell_iy, area): one row a cell where wrapped cells come twice, with the larger area."""
    return segments.groupBy(*ids, "cell_ix", "cell_iy").agg(F.max(value(area)).alias(area))


def large_segments(segments: DataFrame, unit: list[str], least: float = 1.0, area: str = "area_raw") -> tuple[DataFrame, DataFrame]:
    """Segments of at least an area, and by unit what was left out: dropped, discarded_share, gone (nothing left)."""
    small = F.col(area) < least
    lost = sum0(F.when(small, F.col(area)))
    account = segments.groupBy(*unit).agg(F.count_if(small).alias("dropped"), F.try_divide(lost, F.sum(area)).alias("discarded_share"), (F.count_if(~small) == 0).alias("gone"))
    return segments.where(~small), account.where("dropped > 0")


def covered_share(segments: DataFrame, units: DataFrame, unit: list[str], threshold: float = 0.999) -> DataFrame:
    """(unit, share): units of which less than the threshold is covered."""
    got = segments.groupBy(*unit).agg(F.sum("area_raw").alias("_s"))
    share = F.coalesce("_s", F.lit(0.0)) / F.nullif(F.col("area"), F.lit(0.0))
    return units.join(got, unit, "left").select(*unit, share.alias("share")).where(F.col("share") < threshold)


def uniform_resolution(coordinates: DataFrame, column: str, tolerance: float = 1e-9) -> float:
    """The constant step between the distinct values of a column; steps that differ, or fewer than two values, raise.

    Without ordering all values: with smallest value a, n values and step (b - a) / (n - 1), each value must lie on the lattice.
    """
    x = value(column)
    low, high, n = coordinates.agg(F.min(x), F.max(x), F.count_distinct(x)).first()
    if n < 2:
        raise ValueError("a resolution needs two coordinates or more")
    step = (high - low) / (n - 1)
    at = (x - low) / step
    worst = coordinates.agg(F.max(F.abs(at - F.round(at)) * step)).first()[0]
    if worst > tolerance:
        raise ValueError(f"the coordinates of {column} are not evenly spaced: {worst} off a step of {step}")
    return step
