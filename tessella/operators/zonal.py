"""Sums of raster pixels over polygons. A raster is a table of pixels (px, py, value) on a regular grid, so zonal sums are joins on pixel numbers; no geometry is sent to a pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings as rg
from ..functions.nulls import value
from ..functions.session import importable
from . import polygons as pg
from .grid import GridSpec

COVERAGES = ("exact_fraction", "pixel_centroid")
KINDS = ("point_sum", "area_weighted_sum")


def pixels(points: DataFrame, grid: GridSpec, lon: str = "lon", lat: str = "lat", value_col: str = "value", nodata: float | None = None) -> DataFrame:
    """(px, py, value) of a table of pixel centres; the nodata value and NaN are missing, rows of one pixel are summed."""
    x = value(value_col)
    if nodata is not None:
        x = F.when(x != nodata, x)
    return points.select(grid.ix(F.col(lon)).alias("px"), grid.iy(F.col(lat)).alias("py"), x.alias("value")).where("value IS NOT NULL").groupBy("px", "py").agg(F.sum("value").alias("value"))


def row_areas(spark, grid: GridSpec) -> DataFrame:
    """(py, area): square metres of a pixel in each row of the grid, the same at all longitudes."""
    rows = []
    for iy in range(grid.n_iy):
        low = (iy - grid.half) * grid.resolution - 90
        lo, hi = max(low, -90.0), min(low + grid.resolution, 90.0)
        rows.append((iy, rg.geodesic_area([rg.np.array([(0, lo), (grid.resolution, lo), (grid.resolution, hi), (0, hi)], float)])))
    return spark.createDataFrame(rows, "py long, area double")


def area_weighted(raster: DataFrame, grid: GridSpec) -> DataFrame:
    """Pixels of fractions as square metres: value times the area of the pixel's row. The table of rows has n_iy of them and goes to every task."""
    return raster.join(F.broadcast(row_areas(raster.sparkSession, grid)), "py").select("px", "py", (F.col("value") * F.col("area")).alias("value"))


def zonal_sums(segments: DataFrame, ids: list[str], raster: DataFrame, grid: GridSpec, *, coverage: str = "exact_fraction", kind: str = "point_sum", geometry: str = "geometry") -> DataFrame:
    """(ids, raw) of segments(ids, geometry): pixel values by the covered share of the pixel, or of pixels whose centre lies inside. Segments without pixels have 0; rows of equal ids are summed."""
    if coverage not in COVERAGES or kind not in KINDS:
        raise ValueError(f"coverage must be one of {COVERAGES} and kind one of {KINDS}, not {coverage!r} and {kind!r}")
    if kind == "area_weighted_sum":
        raster = area_weighted(raster, grid)
    own = [f"_id{i}" for i in range(len(ids))]  # the ids may be called like pixels or cells
    shapes = segments.select(*(F.col(c).alias(k) for c, k in zip(ids, own)), geometry)
    if coverage == "exact_fraction":
        covered = pg.cells(shapes, own, grid, geometry).select(*own, F.col("cell_ix").alias("px"), F.col("cell_iy").alias("py"), F.col("fraction").alias("share"))
    else:
        covered = centres(shapes, own, grid, geometry).withColumn("share", F.lit(1.0))
    sums = covered.join(raster, ["px", "py"]).groupBy(*own).agg(F.sum(F.col("value") * F.col("share")).alias("_s"))
    return shapes.select(*own).distinct().join(sums, own, "left").select(*(F.col(k).alias(c) for c, k in zip(ids, own)), F.coalesce("_s", F.lit(0.0)).alias("raw"))


def centres(segments: DataFrame, ids: list[str], grid: GridSpec, geometry: str = "geometry") -> DataFrame:
    """(ids, px, py) of the pixels whose centre lies strictly inside a segment."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    importable(segments.sparkSession)
    res, west, half, n_ix, n_iy = grid.resolution, grid.west, grid.half, grid.n_ix, grid.n_iy
    schema = T.StructType([*(segments.schema[c] for c in ids), T.StructField("px", T.LongType()), T.StructField("py", T.LongType())])

    def run(batches):
        for batch in batches:
            for i, g in enumerate(batch.column(len(ids)).to_pylist()):
                rings = rg.from_wkb(g) if g is not None else []
                if not rings:
                    continue
                x0, y0, x1, y1 = rg.bounds(rings)
                ix = np.arange(int(np.floor((x0 - west) / res + half)), int(np.floor((x1 - west) / res + half)) + 1)
                for iy in range(int(np.floor((y0 + 90) / res + half)), int(np.floor((y1 + 90) / res + half)) + 1):
                    x, y = (ix + 0.5 - half) * res + west, np.full(len(ix), (iy + 0.5 - half) * res - 90)
                    some = ix[rg.contains(rings, x, y)]
                    if len(some):
                        own = [batch.column(c).slice(i, 1).take(pa.array([0] * len(some))) for c in range(len(ids))]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(some % n_ix), pa.array(np.full(len(some), min(max(iy, 0), n_iy - 1)))], schema.names)

    return segments.select(*ids, geometry).mapInArrow(run, schema)
