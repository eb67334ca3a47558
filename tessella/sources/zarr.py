"""Zarr arrays of version 2, uncompressed or deflated, as long tables; one row of input a chunk."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.session import importable
from .artifacts import read_text


def read_array(spark: SparkSession, path: str, dims: list[str] | None = None, value_col: str = "value") -> DataFrame:
    """(index of each dimension, value) of every cell of an array; missing chunks have no rows, NaN is kept. dims default to the attributes' names."""
    importable(spark)
    meta = json.loads(read_text(spark, f"{path}/.zarray"))
    if dims is None:
        dims = json.loads(read_text(spark, f"{path}/.zattrs"))["_ARRAY_DIMENSIONS"]
    kind, shape, chunks = np.dtype(meta["dtype"]), meta["shape"], meta["chunks"]
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip") or meta.get("filters"):
        raise ValueError(f"{path}: compressor {codec!r} or its filters aren't read")
    mark, order = meta.get("dimension_separator", "."), meta.get("order", "C")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                tail = name.rstrip("/").split("/")
                at = [int(x) for x in (tail[-1].split(".") if mark == "." else tail[-len(shape) :])]
                raw = bytes(content)
                if codec:
                    raw = zlib.decompress(raw, 47)
                x = np.frombuffer(raw, kind).reshape(chunks, order=order)
                x = x[tuple(slice(0, min(c, s - a * c)) for a, c, s in zip(at, chunks, shape))]
                index = np.indices(x.shape).reshape(len(shape), -1)
                yield pd.DataFrame({**{d: index[k] + at[k] * chunks[k] for k, d in enumerate(dims)}, value_col: x.reshape(-1).astype(float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9]*").load(path)
    return files.select("path", "content").mapInPandas(run, ", ".join([*(f"`{d}` bigint" for d in dims), f"`{value_col}` double"]))
