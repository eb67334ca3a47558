"""Target layers: a source layer, edited on the record, dissolved to levels, with an account of all of it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons as pg
from ..sources import artifacts, vector


@dataclass(frozen=True)
class Level:
    name: str
    keys: tuple[str, ...]
    names: tuple[str, ...] = ()


def prepare(spark: SparkSession, path: str, levels: list[Level], folder: str, *, version: str, drop: str | None = None, repair: Callable[[DataFrame], DataFrame] | None = None, repair_record: str | None = None, tolerance: float = 1e-6) -> dict:
    """Write folder/<level>.parquet (keys, names, geometry) for each level and targets.manifest.json; returns the account.

    Only the columns that levels need are read. The source must say that its coordinates are
    longitude and latitude. repair edits values, never the number of rows, and comes with a
    record of what it does. drop is an SQL condition for rows to leave out; one that matches
    nothing raises. Areas are conserved within `tolerance`.
    """
    if (repair is None) != (repair_record is None):
        raise ValueError("a repair comes with its record, and a record with its repair")
    needed = list(dict.fromkeys(c for x in levels for c in (*x.keys, *x.names)))
    df = vector.read_regions(spark, path, ids=needed, columns=needed, need_crs=not path.lower().endswith("parquet"))
    n = df.count()
    if repair is not None:
        df = df.transform(repair)
        if df.count() != n:
            raise ValueError(f"the repair changed the number of rows from {n} to {df.count()}")
    dropped = 0
    if drop is not None:
        dropped = df.where(drop).count()
        if not dropped:
            raise ValueError(f"{drop!r} matches no row")
        df = df.where(~F.coalesce(F.expr(drop), F.lit(False)))
    account = {"source": path, "source_sha256": artifacts.sha256(spark, path), "rows": n, "dropped": dropped, "drop": drop, "repair": repair_record, "version": version, "levels": {}}
    for level in levels:
        _, broken = pg.mended(df, list(level.keys))
        units = pg.dissolved(df, list(level.keys), names=level.names, tolerance=tolerance)
        out = f"{folder}/{level.name}.parquet"
        units.write.mode("overwrite").parquet(out)
        units = spark.read.parquet(out)
        row = units.agg(F.count(F.lit(1)), F.sum("piece_area"), F.sum("union_area")).first()
        account["levels"][level.name] = {"path": out, "keys": list(level.keys), "names": list(level.names), "units": row[0], "source_area": row[1], "dissolved_area": row[2], "repaired": broken.where("status = 'invalid'").count()}
    artifacts.write_text(spark, json.dumps(account, sort_keys=True, indent=1), f"{folder}/targets.manifest.json")
    return account
