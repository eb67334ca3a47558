"""Command line: python -m tessella.cli validate | run | pipeline | regions | fetch | cache."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, validate, zonal
from .operators.grid import GridSpec, uniform_resolution
from .plans import config as cf
from .plans import generate, montecarlo
from .plans.schema import WeightsArtifact
from .sources import artifacts, raster, registry, vector

TEST_REGIONS = 3


def session() -> SparkSession:
    return SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def missing_inputs(spark: SparkSession, cfg: cf.Config) -> list[str]:
    """Paths of the configuration that don't exist."""
    paths = [cfg.regions.path, cfg.source and cfg.source.path, cfg.grid and cfg.grid.path, *(w.raster for w in cfg.weights)]
    return [p for p in paths if p and not montecarlo.exists(spark, p)]


def grid_of(spark: SparkSession, grid: cf.Grid) -> GridSpec:
    """The grid of a configuration; a prebuilt one is known by its evenly spaced cell centres."""
    west = -180.0 if grid.lon_convention == cf.CONVENTIONS[0] else 0.0
    if grid.mode == "generate":
        return GridSpec(grid.resolution, grid.offset, west)
    cells = spark.table(grid.table) if grid.table else spark.read.parquet(grid.path)
    steps = {c: uniform_resolution(cells.select(c).distinct(), c) for c in ("cell_lon", "cell_lat")}
    if abs(steps["cell_lon"] - steps["cell_lat"]) > 1e-9:
        raise ValueError(f"cells aren't square: {steps}")
    low = cells.agg(F.min("cell_lon")).first()[0]
    half = abs((low + 180) / steps["cell_lon"] % 1 - 0.5) < 1e-6
    return GridSpec(steps["cell_lon"], "edge" if half else "center")


def weight_of(spark: SparkSession, entry: cf.WeightEntry) -> generate.Weight:
    """A weight with its pixels: of a GeoTIFF (its step is the resolution), or of a Parquet path or table of (longitude, latitude, value)."""
    if entry.name == "area":
        return generate.Weight("area", fallback=entry.fallback)
    if entry.raster and entry.raster.lower().endswith((".tif", ".tiff")):
        points = raster.points(spark, entry.raster)
        step = entry.resolution or uniform_resolution(points.select("lon").distinct(), "lon")
        points = points.withColumnRenamed("value", "v")
        lon, lat, value = "lon", "lat", "v"
    else:
        points = spark.table(entry.table) if entry.table else spark.read.parquet(entry.raster)
        lon, lat = ("longitude", "latitude") if "longitude" in points.columns else ("lon", "lat")
        value = raster.value_column(entry.name)
        value = value if value in points.columns else "value"
        step = entry.resolution or uniform_resolution(points.select(lon).distinct(), lon)
    pixel_grid = GridSpec(step)
    return generate.Weight(entry.name, zonal.pixels(points, pixel_grid, lon, lat, value), pixel_grid, entry.kind, entry.fallback)


def regions_of(spark: SparkSession, cfg: cf.Config) -> tuple[DataFrame, DataFrame | None]:
    """The regions, filtered by keep and drop, and the ids that keep asked for by the first id field."""
    r = cfg.regions
    df = vector.read_regions(spark, r.path, table=r.table, ids=r.id_fields)
    asked = None
    if r.keep and list(r.keep) == r.id_fields:
        asked = spark.createDataFrame([(str(x),) for x in r.keep[r.id_fields[0]]], f"`{r.id_fields[0]}` string") if len(r.id_fields) == 1 else None
    kept = compare.keep_drop(df, None if asked is not None else r.keep, r.drop)
    return kept, asked


def generated(spark: SparkSession, cfg: cf.Config, test_mode: bool = False, persist: str | None = None) -> WeightsArtifact:
    """The weights of a configuration; in test mode of its first few regions only."""
    regions, asked = regions_of(spark, cfg)
    ids = cfg.regions.id_fields
    if test_mode:
        regions = regions.orderBy(*ids).limit(TEST_REGIONS)
    weights = [weight_of(spark, w) for w in cfg.weights]
    common = {"coverage": cfg.coverage, "on_invalid": cfg.regions.on_invalid_geometry, "on_null": cfg.regions.on_null_geometry, "tolerance": cfg.validation.sum_tolerance, "persist": persist}
    if cfg.grid is not None:
        return generate.weights_on_grid(regions, ids, grid_of(spark, cfg.grid), weights, regions_version=cfg.regions.version, requested=asked, on_unknown=cfg.regions.on_unknown_id, **common)
    s = cfg.source
    sources = vector.read_regions(spark, s.path, ids=s.id_fields)
    zero = "skip" if test_mode else s.on_zero_overlap
    return generate.weights_on_polygons(regions, ids, sources, s.id_fields, weights, normalization=cfg.normalization, regions_version=cfg.regions.version, source_version=s.version, min_segment_m2=cfg.min_segment_area_m2, on_zero_overlap=zero, coverage_threshold=s.coverage_threshold, **common)


class SparkBackend:
    """Weights by this package on a session; `persist` is a folder for segments and weights on the way."""

    def __init__(self, spark: SparkSession, persist: str | None = None):
        self.spark, self.persist = spark, persist

    def compute(self, config: cf.Config, test_mode: bool = False) -> WeightsArtifact:
        return generated(self.spark, config, test_mode, self.persist)


def cmd_validate(spark: SparkSession, args) -> int:
    cfg = cf.load(args.config)
    lost = missing_inputs(spark, cfg)
    print("\n".join(f"missing: {p}" for p in lost) or f"{cfg.project.name}: ready")
    return bool(lost)


def cmd_run(spark: SparkSession, args) -> int:
    cfg = cf.load(args.config)
    if lost := missing_inputs(spark, cfg):
        print("\n".join(f"missing: {p}" for p in lost))
        return 1
    out = cfg.output.dir
    artifact = SparkBackend(spark, f"{out}/.work").compute(cfg, args.test_mode)
    inputs = {k: p for k, p in {"regions": cfg.regions.path, "source": cfg.source and cfg.source.path, **{f"weight:{w.name}": w.raster for w in cfg.weights}}.items() if p}
    for path in artifacts.write_artifact(artifact, out, cfg.output.format, single=cfg.output.single, inputs=inputs):
        print(path)
    if args.legacy_csv:
        names = tuple(n for n in artifact.schema.weights)
        print(compare.write_legacy_csv(artifact.frame, f"{out}/legacy.csv", id_col=cfg.regions.id_fields[0], names=names))
    bad = validate.sum_to_one(artifact.frame, artifact.schema, cfg.validation.sum_tolerance).limit(1).collect()
    return bool(bad)


def cmd_pipeline(spark: SparkSession, args) -> int:
    result = montecarlo.run_config(spark, args.config, dry_run=args.dry_run)
    if args.dry_run:
        for leaf in result:
            print(json.dumps(leaf))
        print(f"{len(result)} leaves")
    return 0


def cmd_regions(spark: SparkSession, args) -> int:
    cfg = cf.load(args.config)
    df = vector.read_regions(spark, cfg.regions.path, table=cfg.regions.table, ids=cfg.regions.id_fields)
    column = args.column or cfg.regions.id_fields[0]
    found = compare.find_ids(df, column, args.like, args.limit).collect()
    for r in found:
        print(r[0])
    print(f"{len(found)} of {df.where(F.col(column).like(args.like)).select(column).distinct().count()} matches")
    return 0


def cmd_fetch(spark: SparkSession | None, args) -> int:
    if args.list:
        for name, e in sorted(registry.load_registry(args.registry).items()):
            print(f"{name}\trecord {e.number}")
        return 0
    artifact = registry.fetch_weights(spark, args.name, record=args.record, registry=args.registry, cache=args.cache, refresh=args.refresh)
    print(f"{args.name}: {artifact.frame.count()} rows, {list(artifact.schema.weights)}")
    return 0


def cmd_cache(spark: SparkSession | None, args) -> int:
    if args.action == "list":
        for c in registry.cached(args.cache):
            print(f"{c['name']}\trecord {c['record']}\t{c['bytes']} bytes\t{c['path']}")
    else:
        print(f"{registry.clear_cache(args.cache, args.name)} removed")
    return 0


def cmd_estimate(spark: SparkSession, args) -> int:
    """Bytes that Spark expects to read for the inputs of a configuration."""
    cfg = cf.load(args.config)
    total = 0
    for path in [cfg.regions.path, cfg.source and cfg.source.path, *(w.raster for w in cfg.weights)]:
        if path:
            fs, p = artifacts._fs(spark, path)
            size = fs.getContentSummary(p).getLength()
            total += size
            print(f"{size}\t{path}")
    print(f"{total} bytes in all")
    return bool(args.ceiling and total > args.ceiling)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessella")
    sub = out.add_subparsers(required=True)

    def command(name, run, spark=True, **more):
        p = sub.add_parser(name, **more)
        p.set_defaults(run=run, spark=spark)
        return p

    for name, run in (("validate", cmd_validate), ("run", cmd_run), ("pipeline", cmd_pipeline), ("regions", cmd_regions), ("estimate", cmd_estimate)):
        p = command(name, run)
        p.add_argument("config")
        if name == "run":
            p.add_argument("--test-mode", action="store_true")
            p.add_argument("--legacy-csv", action="store_true")
        if name == "pipeline":
            p.add_argument("--dry-run", action="store_true")
        if name == "regions":
            p.add_argument("like")
            p.add_argument("--column")
            p.add_argument("--limit", type=int, default=50)
        if name == "estimate":
            p.add_argument("--ceiling", type=int)
    p = command("fetch", cmd_fetch)
    p.add_argument("name", nargs="?")
    p.add_argument("--record")
    p.add_argument("--registry")
    p.add_argument("--cache")
    p.add_argument("--refresh", action="store_true")
    p.add_argument("--list", action="store_true")
    p = command("cache", cmd_cache, spark=False)
    p.add_argument("action", choices=("list", "clear"))
    p.add_argument("name", nargs="?")
    p.add_argument("--cache")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return int(args.run(session() if args.spark and not getattr(args, "list", False) else None, args))
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
