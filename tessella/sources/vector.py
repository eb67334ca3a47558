"""Polygon layers: GeoParquet, shapefiles and warehouse tables as DataFrames with a WKB column."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings as rg

#: Shapefile kinds of polygons, without and with further ordinates.
POLYGON_KINDS = (5, 15, 25)


def shapes(data: bytes) -> list[bytes | None]:
    """WKB of every record of a .shp file of polygons; null shapes are None."""
    out, at = [], 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body)
        if kind == 0:
            out.append(None)
            continue
        if kind not in POLYGON_KINDS:
            raise ValueError(f"shape kind {kind} is no polygon")
        parts, points = struct.unpack_from("<2i", body, 36)
        first = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        rings = [xy[a : b - 1][::-1] for a, b in zip(first, first[1:]) if b - a > 3]  # shells run clockwise in the file
        out.append(rg.wkb_of(rings) if rings else None)
    return out


def records(data: bytes, encoding: str = "utf-8") -> list[dict]:
    """Rows of a .dbf file: text, whole and other numbers, booleans; blanks are None."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding)
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, kind, length, decimals in fields:
            raw = data[at : at + length].decode(encoding, "replace").strip().strip("\0")
            at += length
            if not raw:
                row[name] = None
            elif kind in "NF":
                row[name] = float(raw) if decimals or kind == "F" or "." in raw else int(raw)
            elif kind == "L":
                row[name] = raw in "TtYy"
            else:
                row[name] = raw
        out.append(row)
    return out


def _whole(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_regions(spark: SparkSession, path: str | None = None, *, table: str | None = None, ids: list[str] | None = None, columns: list[str] | None = None, need_crs: bool = False) -> DataFrame:
    """A polygon layer with its columns and `geometry` as WKB: .parquet or .geoparquet, .shp (with .dbf beside it, and .prj), or a table. Any path that Spark reads will do.

    Missing id columns raise. Coordinates are taken as longitude and latitude; a file that says
    it has others raises, and with need_crs so does one that doesn't say.
    """
    if (path is None) == (table is None):
        raise ValueError("a layer comes from a path or from a table")
    if table is not None:
        df = spark.table(table)
    elif path.lower().endswith((".parquet", ".geoparquet")):
        df = spark.read.parquet(path)
        _check_crs(_geo_crs(spark, path), path, need_crs)
    elif path.lower().endswith(".shp"):
        stem = path[:-4]
        geo, rows = shapes(_whole(spark, path)), records(_whole(spark, stem + ".dbf"))
        if len(geo) != len(rows):
            raise ValueError(f"{path}: {len(geo)} shapes and {len(rows)} rows")
        try:
            crs = _whole(spark, stem + ".prj").decode("utf-8", "replace")
        except Exception:
            crs = None
        _check_crs(crs, path, need_crs)
        names = list(rows[0]) if rows else []
        kind = lambda c: next(({str: "string", int: "bigint", float: "double", bool: "boolean"}[type(r[c])] for r in rows if r[c] is not None), "string")
        df = spark.createDataFrame([(*(r[c] for c in names), None if g is None else bytearray(g)) for r, g in zip(rows, geo)], ", ".join([*(f"`{c}` {kind(c)}" for c in names), "geometry binary"]))
    else:
        raise ValueError(f"{path}: a layer is .parquet, .geoparquet or .shp")
    if lost := [c for c in (ids or []) if c not in df.columns]:
        raise ValueError(f"{path or table} lacks id columns {lost}; it has {df.columns}")
    return df.select(*dict.fromkeys([*(ids or []), *columns, "geometry"])) if columns is not None else df


def _geo_crs(spark: SparkSession, path: str) -> str | None:
    """What the metadata of a GeoParquet file say of its coordinates: nothing said there means longitude and latitude."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if fs.getFileStatus(root).isDirectory():
        return None
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(root, conf))
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    if text is None:
        return None
    column = next(iter(json.loads(text).get("columns", {}).values()), {})
    crs = column.get("crs", "OGC:CRS84")
    return json.dumps(crs) if isinstance(crs, dict) else crs


def _check_crs(crs: str | None, path: str, need: bool) -> None:
    if crs is None:
        if need:
            raise ValueError(f"{path} doesn't say what its coordinates are")
        return
    flat = crs.upper().replace(" ", "").replace("_", "")
    if not any(x in flat for x in ("CRS84", "EPSG:4326", "WGS84", "WGS1984", '"CODE":4326')) or "PROJCS" in flat:
        raise ValueError(f"{path} has other coordinates than longitude and latitude: {crs[:120]}")


def geometries(regions: DataFrame, ids: list[str], wanted: list | None = None) -> DataFrame:
    """ids and geometry of the rows that have one, of the wanted ids only if given."""
    out = regions.where(F.col("geometry").isNotNull()).select(*ids, "geometry")
    return out if wanted is None else out.where(F.col(ids[0]).isin(list(wanted)))
