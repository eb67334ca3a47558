"""Polygons on grids and on polygons: areas, covered cells, overlaps, points in regions.

Geometries are WKB columns (GeoParquet needs nothing but spark.read.parquet). Each polygon is
clipped to the bins of a coarse grid once; only those pieces, which together are about as large
as the polygon, are shuffled, and both sides meet by an equi-join on the bin, so neither is
broadcast. The kernels see one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rings as rg
from ..functions.session import importable
from .grid import GridSpec

EDGE_DEGREES = 1e-4
BOX = ("x0", "y0", "x1", "y1")


def _doubles(df: DataFrame, cols, names) -> T.StructType:
    return T.StructType([df.schema[c] for c in cols] + [T.StructField(n, T.DoubleType()) for n in names])


def described(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """df with x0, y0, x1, y1, planar_area and geodesic_area (m2, WGS84). Null or empty polygons get nulls."""
    importable(df.sparkSession)
    names = [*BOX, "planar_area", "geodesic_area"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for g in batch.column(batch.schema.get_field_index(geometry)).to_pylist():
                rings = rg.from_wkb(g) if g is not None else []
                found.append((*rg.bounds(rings), rg.planar_area(rings), rg.geodesic_area(rings)) if rings else (None,) * 6)
            cols = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in cols)], [*batch.schema.names, *names])

    return df.mapInArrow(run, _doubles(df, df.columns, names))


def outside_domain(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows whose box leaves lon -180..180 or lat -90..90 by more than 1e-4 degrees."""
    e = EDGE_DEGREES
    return described(df, geometry).where((F.col("x0") < -180 - e) | (F.col("x1") > 180 + e) | (F.col("y0") < -90 - e) | (F.col("y1") > 90 + e))


def digest(df: DataFrame, ids: list[str], geometry: str = "geometry") -> str:
    """16 hex digits of a set of ids and geometries, whatever the order of its rows."""
    h = F.xxhash64(*ids, geometry)
    low, n = df.agg(F.bit_xor(h), F.count(F.lit(1))).first()
    return f"{((low or 0) ^ n) & (2**64 - 1):016x}"


def boxes(df: DataFrame, ids: list[str], geometry: str = "geometry") -> DataFrame:
    """ids and geometry of rows with x0, y0, x1, y1 as polygons."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = np.stack([batch.column(len(ids) + k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            shapes = [rg.to_wkb([[(a, b), (c, b), (c, d), (a, d)]]) for a, b, c, d in at.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(shapes, pa.binary())], [*ids, geometry])

    plain = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in BOX))
    return plain.mapInArrow(run, T.StructType([*(df.schema[c] for c in ids), T.StructField(geometry, T.BinaryType())]))


POLICIES = ("repair", "skip", "error")


def mended(df: DataFrame, ids: list[str], policy: str = "repair", geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """(df, account): polygons that cross or touch themselves are repaired (same area by even and odd crossings), left out, or raise; account(ids, status) lists those that are invalid, null or empty.

    Null and empty polygons are left out; lines and points among the parts don't count.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    importable(df.sparkSession)
    state = "_state"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = batch.schema.get_field_index(geometry)
            shapes, states = [], []
            for g in batch.column(at).to_pylist():
                rings = rg.from_wkb(g) if g is not None else []
                ok = bool(rings) and rg.is_valid(rings)
                states.append("null" if g is None else "empty" if not rings else None if ok else "invalid")
                shapes.append(g if ok or not rings or policy != "repair" else rg.wkb_of(rg.repaired(rings)))
            columns = [pa.array(shapes, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.string())], [*batch.schema.names, state])

    seen = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(state, T.StringType())]))
    account = seen.where(F.col(state).isNotNull()).select(*ids, F.col(state).alias("status"))
    if policy == "error" and (bad := account.where("status = 'invalid'").limit(5).collect()):
        raise ValueError(f"invalid polygons, such as {[tuple(r)[:-1] for r in bad]}")
    stay = F.col(state).isNull() | (F.col(state) == "invalid") if policy == "repair" else F.col(state).isNull()
    return seen.where(stay).drop(state), account


def domain_edge(df: DataFrame, ids: list[str], what: str, geometry: str = "geometry") -> DataFrame:
    """(ids, overshoot): units that leave lon -180..180 or lat -90..90 by 1e-4 degrees or less; more raises."""
    over = F.greatest(F.lit(0.0), -180 - F.col("x0"), F.col("x1") - 180, -90 - F.col("y0"), F.col("y1") - 90)
    out = described(df.select(*ids, geometry), geometry).select(*ids, over.alias("overshoot")).where("overshoot > 0")
    if bad := out.where(F.col("overshoot") > EDGE_DEGREES).limit(5).collect():
        raise ValueError(f"{what}: coordinates outside lon -180..180 and lat -90..90, such as {[tuple(r) for r in bad]}")
    return out


def inner_points(df: DataFrame, ids: list[str], geometry: str = "geometry") -> DataFrame:
    """(ids, lon, lat): a point inside each polygon; null and empty ones have none."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rings = [rg.from_wkb(g) if g is not None else [] for g in batch.column(len(ids)).to_pylist()]
            found = [rg.inner_point(r) if r else (None, None) for r in rings]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *(pa.array([f[k] for f in found], pa.float64()) for k in range(2))], [*ids, "lon", "lat"])

    return df.select(*ids, geometry).mapInArrow(run, _doubles(df, ids, ["lon", "lat"])).where("lon IS NOT NULL")


def _cells(rings: rg.Rings, grid: GridSpec):
    """(ix, iy, rings of the piece, whether it is the whole cell) of every cell that a polygon meets: rows of cells first, then the cells of a row. Stretches of cells inside are found from the edges of the row alone."""
    parts = rg.hemispheres(rings)
    if len(parts) > 1:  # both may hold a piece of the cells at longitude 0
        found: dict[tuple[int, int], list] = {}
        for part in parts:
            for ix, iy, piece, full in _part_cells(part, grid):
                seen = found.setdefault((ix, iy), [[], False])
                seen[0], seen[1] = seen[0] + piece, full
        yield from ((*at, piece, full) for at, (piece, full) in found.items())
    else:
        yield from _part_cells(rings, grid)


def _part_cells(part: rg.Rings, grid: GridSpec):
    """_cells() of a polygon within one hemisphere, or away from the antimeridian."""
    res, west, half, n_ix, n_iy = grid.resolution, grid.west, grid.half, grid.n_ix, grid.n_iy
    x0, y0, x1, y1 = rg.bounds(part)
    for iy in range(int(np.floor((y0 + 90) / res + half)), int(np.floor((y1 + 90) / res + half)) + 1):
        low = (iy - half) * res - 90
        row = rg.clip_box(part, x0, low, x1, low + res)
        if not row:
            continue
        p, q = rg.edges(row)
        rx0, rx1 = p[:, 0].min(), p[:, 0].max()
        first, last = (int(np.floor((x - west) / res + half)) for x in (rx0, rx1))
        # cells that only edges along their own upper and lower line cross are whole or empty
        flat = (p[:, 1] == q[:, 1]) & ((p[:, 1] == low) | (p[:, 1] == low + res))
        a, b = (f(p[~flat, 0], q[~flat, 0]) for f in (np.minimum, np.maximum))
        touched = np.zeros(last - first + 2, np.int64)
        np.add.at(touched, np.clip(np.floor((a - west) / res + half).astype(int) - first, 0, last - first), 1)
        np.add.at(touched, np.clip(np.floor((b - west) / res + half).astype(int) - first, 0, last - first) + 1, -1)
        touched = np.cumsum(touched)[:-1] > 0
        middle = ((np.arange(first, last + 1) - half + 0.5) * res + west, np.full(last - first + 1, low + res / 2))
        whole = ~touched & rg.contains(row, *middle)
        for ix in (np.flatnonzero(touched | whole) + first).tolist():
            left = (ix - half) * res + west
            at = ix % n_ix, min(max(iy, 0), n_iy - 1)
            if whole[ix - first]:
                yield *at, [np.array([(left, low), (left + res, low), (left + res, low + res), (left, low + res)])], True
            else:
                piece = rg.clip_box(row, left, low, left + res, low + res)
                if rg.planar_area(piece) > 0:
                    yield *at, piece, False


def cells(df: DataFrame, ids: list[str], grid: GridSpec, geometry: str = "geometry", shapes: bool = False) -> DataFrame:
    """ids, cell_ix, cell_iy, fraction (planar share of the cell), area_raw (m2) and is_interior of every cell that a polygon covers in part; with `shapes` the piece as WKB as well.

    A polygon whose box touches both sides of the antimeridian is split at longitude 0 first.
    Cells that no edge enters are taken whole. Rows with equal ids stay apart. Null polygons
    have no cells.
    """
    importable(df.sparkSession)
    res = grid.resolution
    extra = [T.StructField("cell_ix", T.LongType()), T.StructField("cell_iy", T.LongType()), T.StructField("fraction", T.DoubleType()), T.StructField("area_raw", T.DoubleType()), T.StructField("is_interior", T.BooleanType())]
    schema = T.StructType([*(df.schema[c] for c in ids), *extra, *([T.StructField(geometry, T.BinaryType())] if shapes else [])])

    def run(batches: Iterator[pa.RecordBatch]):
        whole: dict[int, float] = {}
        for batch in batches:
            for i, g in enumerate(batch.column(len(ids)).to_pylist()):
                rings = rg.from_wkb(g) if g is not None else []
                found = []
                for ix, iy, piece, full in _cells(rings, grid) if rings else ():
                    if full and iy not in whole:
                        whole[iy] = rg.geodesic_area(piece)
                    share = 1.0 if full else rg.planar_area(piece) / res**2
                    inside = full or share >= 1 - 1e-12  # covered, with edges along its sides
                    found.append((ix, iy, share, whole[iy] if full else rg.geodesic_area(piece), inside, *([rg.wkb_of(piece)] if shapes else [])))
                for k in range(0, len(found), 4096):
                    some = found[k : k + 4096]
                    own = [batch.column(c).slice(i, 1).take(pa.array([0] * len(some))) for c in range(len(ids))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in zip(*some))], schema.names)

    return df.select(*ids, geometry).mapInArrow(run, schema)


def pieces(df: DataFrame, ids: list[str], size: float, geometry: str = "geometry", margin: float = 0.0) -> DataFrame:
    """ids, _bx, _by, geometry: each polygon clipped to the bins of `size` degrees that it meets, each bin wider by `margin` on all sides."""
    importable(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in ids), T.StructField("_bx", T.LongType()), T.StructField("_by", T.LongType()), T.StructField(geometry, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, g in enumerate(batch.column(len(ids)).to_pylist()):
                rings = rg.from_wkb(g) if g is not None else []
                if not rings:
                    continue
                _, y0, _, y1 = rg.bounds(rings)
                for by in range(int(np.floor((y0 - margin) / size)), int(np.floor((y1 + margin) / size)) + 1):
                    row = rg.clip_box(rings, -1e9, by * size - margin, 1e9, (by + 1) * size + margin)
                    if not row:
                        continue
                    x0, _, x1, _ = rg.bounds(row)
                    found = []
                    for bx in range(int(np.floor((x0 - margin) / size)), int(np.floor((x1 + margin) / size)) + 1):
                        part = rg.clip_box(row, bx * size - margin, by * size - margin, (bx + 1) * size + margin, (by + 1) * size + margin)
                        if rg.planar_area(part) > 0:
                            found.append((bx, by, rg.wkb_of(part)))
                    if found:
                        own = [batch.column(c).slice(i, 1).take(pa.array([0] * len(found))) for c in range(len(ids))]
                        yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in zip(*found))], schema.names)

    return df.select(*ids, geometry).mapInArrow(run, schema)


def overlay(targets: DataFrame, target_ids: list[str], sources: DataFrame, source_ids: list[str], *, geometry: str = "geometry", bin_degrees: float = 1.0, min_m2: float = 0.0, shapes: bool = False) -> DataFrame:
    """target_ids, source_ids, area_raw (m2), and with `shapes` the geometry, of every pair of polygons that overlap by more than min_m2. The id names of both sides differ.

    Pieces are intersected bin by bin; those of a pair are joined again before its area is taken,
    as the cuts between bins follow parallels, which geodesic edges don't. A pair's pieces meet
    in one task: they are one row of the result.
    """
    importable(targets.sparkSession)
    if clash := set(target_ids) & set(source_ids):
        raise ValueError(f"both sides name an id {sorted(clash)}")
    a = pieces(targets, target_ids, bin_degrees, geometry).withColumnRenamed(geometry, "_t_g")
    b = pieces(sources, source_ids, bin_degrees, geometry).withColumnRenamed(geometry, "_s_g")
    ids = [*target_ids, *source_ids]
    pairs = a.join(b, ["_bx", "_by"]).select(*ids, "_t_g", "_s_g")

    def meet(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            both = zip(*(batch.column(len(ids) + k).to_pylist() for k in range(2)))
            found = [rg.intersection(rg.from_wkb(x), rg.from_wkb(y)) for x, y in both]
            some = pa.array([bool(f) for f in found], pa.bool_())
            parts = pa.array([rg.wkb_of(f) if f else None for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], parts], [*ids, geometry]).filter(some)

    def whole(key, table):
        table = table if isinstance(table, pa.Table) else pa.Table.from_batches(list(table))
        rings = [rg.from_wkb(g) for g in table.column(geometry).to_pylist()]
        one = rings[0] if len(rings) == 1 else rg.union(rings)
        return pa.table([*(table.column(k).slice(0, 1) for k in ids), pa.array([rg.geodesic_area(one)]), pa.array([rg.wkb_of(one)], pa.binary())], names=[*ids, "area_raw", geometry])

    piece = T.StructType([*(pairs.schema[c] for c in ids), T.StructField(geometry, T.BinaryType())])
    full = _doubles(pairs, ids, ["area_raw"]).add(geometry, T.BinaryType())
    out = pairs.mapInArrow(meet, piece).groupBy(*ids).applyInArrow(whole, full).where(F.col("area_raw") > min_m2)
    return out if shapes else out.drop(geometry)


def points_in(points: DataFrame, regions: DataFrame, ids: list[str], *, lon: str = "lon", lat: str = "lat", geometry: str = "geometry", bin_degrees: float = 1.0) -> DataFrame:
    """Columns of points and ids for every polygon that holds the point (even-odd; points on an edge are in none); points in none have no row.

    A point meets the piece of the polygon around its bin, never the whole polygon.
    """
    importable(points.sparkSession)
    cols = points.columns
    if clash := set(cols) & set(ids):
        raise ValueError(f"both sides name a column {sorted(clash)}")
    at = [F.floor(F.col(c) / bin_degrees).cast("long").alias(k) for c, k in ((lon, "_bx"), (lat, "_by"))]
    near = points.select("*", *at).join(pieces(regions, ids, bin_degrees, geometry, margin=bin_degrees / 16).withColumnRenamed(geometry, "_r_g"), ["_bx", "_by"])
    keep = [*cols, *ids]
    near = near.select(*keep, "_r_g")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = (batch.column(cols.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lon, lat))
            code = batch.column(len(keep)).dictionary_encode()
            which, ok = code.indices.to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for k, g in enumerate(code.dictionary.to_pylist()):
                some = np.flatnonzero(which == k)
                ok[some] = rg.contains(rg.from_wkb(g), x[some], y[some])
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)], keep).filter(pa.array(ok))

    return near.mapInArrow(run, T.StructType([near.schema[c] for c in keep]))


def dissolved(df: DataFrame, keys: list[str], *, names: tuple[str, ...] = (), geometry: str = "geometry", tolerance: float = 1e-6, check: bool = True) -> DataFrame:
    """One row for each combination of keys: the union of its polygons, the smallest value of each name column, and their planar areas piece_area and union_area.

    Missing or null keys raise; so do overlaps that lose more than `tolerance` of the whole area.
    Polygons that cross themselves are repaired. A key's polygons meet in one task: they are one
    unit of the result.
    """
    if lost := [c for c in (*keys, *names, geometry) if c not in df.columns]:
        raise ValueError(f"the layer lacks columns {lost}")
    importable(df.sparkSession)
    if check and (bad := df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).select(*keys).limit(5).collect()):
        raise ValueError(f"null keys, such as {[tuple(r) for r in bad]}")
    names = [c for c in names if c not in keys]
    mended_, _ = mended(df.select(*keys, *names, geometry), keys, "repair", geometry)
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField(geometry, T.BinaryType()), T.StructField("piece_area", T.DoubleType()), T.StructField("union_area", T.DoubleType()), T.StructField("pieces", T.LongType())])

    def run(key, table):
        table = table if isinstance(table, pa.Table) else pa.Table.from_batches(list(table))
        polygons = [rg.from_wkb(g) for g in table.column(geometry).to_pylist()]
        whole = rg.union(polygons) if len(polygons) > 1 else polygons[0]
        area = sum(map(rg.planar_area, polygons))
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), pa.array([rg.wkb_of(whole)], pa.binary()), pa.array([area]), pa.array([rg.planar_area(whole)]), pa.array([len(polygons)], pa.int64())], names=schema.names)

    out = mended_.select(*keys, geometry).groupBy(*keys).applyInArrow(run, schema)
    if names:
        out = out.join(df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in names)), keys)
    if check:
        row = out.agg(F.sum("piece_area"), F.sum("union_area")).first()
        if row[0] and abs(row[0] - row[1]) > tolerance * max(row[0], row[1]):
            worst = out.withColumn("_d", F.col("piece_area") - F.col("union_area")).orderBy(F.desc("_d"), *keys).limit(5).collect()
            raise ValueError(f"area isn't conserved: {row[0]} before, {row[1]} after; most in {[{**{k: r[k] for k in keys}, 'overlap': r['_d']} for r in worst]}")
    return out
