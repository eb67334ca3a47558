"""Single-band GeoTIFF rasters on longitude and latitude as tables of pixels."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.session import importable

#: TIFF field types with their sizes, and the tags that are read.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


@dataclass
class Raster:
    """Values north-up, with the centre of the first pixel and the steps in degrees."""

    values: np.ndarray
    lon: float
    lat: float
    step_x: float
    step_y: float
    nodata: float | None


def read_tiff(data: bytes) -> Raster:
    """A GeoTIFF of one band, uncompressed or deflated, in strips or tiles."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(end + "I", data, 4)
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        if kind not in FIELD:
            continue
        fmt = f"{end}{n}s" if kind == 2 else end + FIELD[kind] * n
        place = at + 10 + 12 * i
        if struct.calcsize(fmt) > 4:
            (place,) = struct.unpack_from(end + "I", data, place)
        tags[tag] = struct.unpack_from(fmt, data, place)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("a raster has one band")
    if SCALE not in tags or TIE not in tags:
        raise ValueError("the raster doesn't say where it lies")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(COMPRESSION)} isn't read; write the raster deflated or uncompressed")
    dtype = np.dtype(end + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8))
    width, height = one(WIDTH), one(HEIGHT)
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across = -(-width // w)
    out = np.zeros((-(-height // h) * h, across * w), dtype.newbyteorder("="))
    for i, (start, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES])):
        raw = data[start : start + size]
        if one(COMPRESSION, 1) != 1:
            raw = zlib.decompress(raw)
        part = np.frombuffer(raw, dtype)
        part = part[: len(part) // w * w].reshape(-1, w)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {one(PREDICTOR)} isn't read")
        y, x = i // across * h, i % across * w
        out[y : y + len(part), x : x + w] = part
    sx, sy = tags[SCALE][:2]
    i, j, _, x, y = tags[TIE][:5]
    text = one(NODATA)
    nodata = float(text.split(b"\0")[0]) if text else None
    return Raster(out[:height, :width], x + (0.5 - i) * sx, y - (0.5 - j) * sy, sx, sy, nodata)


def points(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(lon, lat, value) of the pixels of rasters, nodata and NaN left out; window (x0, y0, x1, y1) keeps pixels whose centre lies in it. A file is read whole by one task."""
    importable(spark)

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                r = read_tiff(bytes(content))
                lon = r.lon + np.arange(r.values.shape[1]) * r.step_x
                if window:
                    lon_ok = (lon >= window[0]) & (lon <= window[2])
                for y in range(r.values.shape[0]):
                    lat = r.lat - y * r.step_y
                    v = r.values[y].astype(float)
                    ok = ~np.isnan(v) if r.nodata is None else ~np.isnan(v) & (v != r.nodata)
                    if window:
                        ok &= lon_ok & (window[1] <= lat <= window[3])
                    if ok.any():
                        yield pd.DataFrame({"lon": lon[ok], "lat": lat, "value": v[ok]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "lon double, lat double, value double")


def value_column(weight: str) -> str:
    """The column of a points table that holds a weight: population for `pop`, else the weight's own name."""
    return "population" if weight == "pop" else weight
