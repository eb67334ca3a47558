"""A tree of Monte Carlo leaves as one plan: read, subtract, apply, window, pool."""

from __future__ import annotations

import itertools
import json
import tomllib
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regroup, stats
from ..operators.apply import apply_weights
from ..sources import artifacts
from ..sources import netcdf as nc
from .schema import WeightsArtifact


@dataclass
class Tree:
    """Leaves at root/<value of each level>/filename; `expect` lists the values of each level, `exclude` combinations that don't exist."""

    root: str
    filename: str
    levels: list[str]
    expect: dict[str, list[str]]
    exclude: list[dict[str, str]] = field(default_factory=list)
    subtract: str | None = None

    def __post_init__(self):
        if sorted(self.expect) != sorted(self.levels) or not all(self.expect.values()):
            raise ValueError("expect needs values for each level and no other")
        if self.subtract == self.filename:
            raise ValueError("a leaf can't be subtracted from itself")
        for e in self.exclude:
            if not e or any(k not in self.expect or v not in self.expect[k] for k, v in e.items()):
                raise ValueError(f"exclude {e} isn't made of declared values")

    def leaves(self) -> list[dict[str, str]]:
        all_ = (dict(zip(self.levels, v)) for v in itertools.product(*(self.expect[x] for x in self.levels)))
        return [x for x in all_ if not any(all(x[k] == v for k, v in e.items()) for e in self.exclude)]

    def path(self, leaf: dict[str, str], filename: str | None = None) -> str:
        return "/".join([self.root.rstrip("/"), *(leaf[x] for x in self.levels), filename or self.filename])


SECTIONS = {
    "tree": {"root", "filename", "levels", "expect", "exclude", "subtract"},
    "weights": {"path", "stem", "weight"},
    "data": {"format", "kind", "value", "denominator", "version", "variables", "region_dim", "region_labels", "schema", "group"},
    "stats": {"time", "windows", "sample_dims", "quantiles", "include_mean", "model_weights", "level"},
    "coverage": {"unmatched", "zero_weight", "absent_from_data", "allow_partial"},
    "output": {"dir", "leaves"},
}


def load_config(path: str) -> dict:
    """A TOML file; unknown keys raise, and relative paths of the tree, the weights, the model weights and the output count from its folder."""
    with open(path, "rb") as f:
        cfg = tomllib.load(f)
    for section, keys in cfg.items():
        if section not in SECTIONS or (unknown := set(keys) - SECTIONS[section]):
            raise ValueError(f"{path}: [{section}] is unknown or has unknown keys {sorted(set(keys) - SECTIONS.get(section, set()))}")
    if lost := [s for s in ("tree", "weights", "data", "stats") if s not in cfg]:
        raise ValueError(f"{path} lacks {lost}")
    for section, key in (("tree", "root"), ("weights", "path"), ("stats", "model_weights"), ("output", "dir")):
        value = cfg.get(section, {}).get(key)
        if value and "://" not in value and not value.startswith("/"):
            cfg[section][key] = str(Path(path).resolve().parent / value)
    check_data(cfg["data"], cfg["tree"].get("subtract"))
    return cfg


def check_data(data: dict, subtract: str | None = None) -> None:
    """Rules between the settings of the leaves."""
    fmt = data.get("format", "parquet")
    if fmt not in ("parquet", "csv", "netcdf"):
        raise ValueError(f"leaves are parquet, csv or netcdf, not {fmt!r}")
    if (fmt == "netcdf") != ("region_dim" in data):
        raise ValueError("region_dim belongs to netcdf leaves, which need it")
    if fmt != "netcdf" and "region_labels" in data:
        raise ValueError("region_labels belongs to netcdf leaves")
    if subtract and data.get("denominator"):
        raise ValueError("a ratio can't be subtracted leaf by leaf")


def run_config(spark: SparkSession, path: str, dry_run: bool = False):
    """run_pipeline() from a TOML file."""
    cfg = load_config(path)
    t, w, d, s, c = (cfg.get(k, {}) for k in ("tree", "weights", "data", "stats", "coverage"))
    tree = Tree(t["root"], t["filename"], t["levels"], {k: [str(x) for x in v] for k, v in t["expect"].items()}, t.get("exclude", []), t.get("subtract"))
    if dry_run:
        return tree.leaves()
    artifact = artifacts.load_artifact(spark, w["path"], w.get("stem", "weights"))
    models = artifacts.model_weights(spark, s["model_weights"]) if "model_weights" in s else None
    return run_pipeline(
        spark, tree, artifact, kind=d["kind"], weight=w["weight"], data_version=d.get("version"), windows=[tuple(x) for x in s["windows"]], sample_dims=s["sample_dims"], quantiles=tuple(s.get("quantiles", ())), time_col=s.get("time", "year"),
        value_col=d.get("value", "value"), denominator=d.get("denominator"), fmt=d.get("format", "parquet"), model_weights=models, model_level=s.get("level"), output=cfg.get("output", {}).get("dir"), keep_leaves=cfg.get("output", {}).get("leaves", False),
        coverage={k: v for k, v in c.items() if k != "allow_partial"}, allow_partial_coverage=c.get("allow_partial", False), netcdf={k: d[k] for k in ("variables", "region_dim", "region_labels") if k in d}, schema=d.get("schema"), include_mean=s.get("include_mean", True),
    )


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, root: str, depth: int) -> set[str]:
    """Names at a depth below a folder, `/` between their parts, by one listing a folder and not one a name."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return set()
    level = [(base, "")]
    for _ in range(depth):
        level = [(f.getPath(), f"{prefix}{f.getPath().getName()}/") for p, prefix in level for f in fs.listStatus(p)]
    return {prefix.rstrip("/") for _, prefix in level}


def missing_leaves(spark: SparkSession, tree: Tree) -> list[str]:
    """Declared leaves that don't exist. Folders are listed level by level, only those that the declared values name."""
    jvm = spark._jvm.org.apache.hadoop.fs
    base = jvm.Path(tree.root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [tree.filename] + ([tree.subtract] if tree.subtract else [])
    folders: dict[tuple, list] = {}
    for leaf in tree.leaves():
        folders.setdefault(tuple(leaf[x] for x in tree.levels[:-1]), []).append(leaf)
    lost = []
    for above, leaves in folders.items():
        path = jvm.Path("/".join([tree.root.rstrip("/"), *above]))
        # one listing tells the last level; a leaf is then looked up by the pattern of its folder's siblings
        found = {"/".join([f.getPath().getParent().getName(), f.getPath().getName()]) for n in names for f in (fs.globStatus(jvm.Path(path, f"*/{n}")) or [])} if fs.exists(path) else set()
        last = tree.levels[-1]
        lost += [tree.path(leaf, n) for leaf in leaves for n in names if f"{leaf[last]}/{n}" not in found]
    return lost


def draws(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below a root, in order."""
    return sorted(listed(spark, root, 1))


def _levels(data: DataFrame, tree: Tree, path, filename: str) -> DataFrame:
    if clash := set(tree.levels) & set(data.columns):
        raise ValueError(f"levels and columns share names: {sorted(clash)}")
    # a leaf may be one file or a folder of part files
    name = filename.replace(".", "[.]")
    tail = F.regexp_extract(path, "((?:[^/]+/){%d})%s(?:/[^/]*)?$" % (len(tree.levels), name), 1)
    parts = F.split(tail, "/")
    return data.select("*", *(F.url_decode(parts[i]).alias(x) for i, x in enumerate(tree.levels)))


def read_leaves(spark: SparkSession, tree: Tree, fmt: str, filename: str | None = None, *, schema: str | None = None, netcdf: dict | None = None, region_col: str | None = None, kind: str | None = None) -> DataFrame:
    """All leaves as one scan, with the levels as columns taken from the paths. CSV leaves without a schema take that of the first leaf, so only one file is read to infer it."""
    paths = [tree.path(x, filename) for x in tree.leaves()]
    if fmt == "netcdf":
        data = nc.read_leaves(spark, paths, (netcdf or {})["variables"], region_dim=netcdf["region_dim"], region_col=region_col, region_labels=netcdf.get("region_labels"), kind=kind, path_col="_path")
        return _levels(data, tree, F.col("_path"), filename or tree.filename).drop("_path")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).schema(schema or spark.read.option("header", True).option("inferSchema", True).csv(paths[0]).schema)
    return _levels(reader.format(fmt).load(paths), tree, F.col("_metadata.file_path"), filename or tree.filename)


def frequent(messages: list[str], k: int = 3) -> list[tuple[str, int]]:
    """The k most frequent messages with their numbers; ties in the order of the text."""
    return sorted(Counter(messages).items(), key=lambda x: (-x[1], x[0]))[:k]


def run_pipeline(
    spark: SparkSession, tree: Tree, artifact: WeightsArtifact, *, kind: str, weight: str, data_version: str, windows: list[tuple[float, float]], sample_dims: list[str], quantiles: tuple[float, ...] = (), time_col: str = "year", value_col: str = "value",
    denominator: str | None = None, fmt: str = "parquet", model_weights: DataFrame | None = None, model_level: str | None = None, output: str | None = None, coverage: dict[str, str] | None = None, allow_partial_coverage: bool = False, dry_run: bool = False,
    keep_leaves: bool = False, netcdf: dict | None = None, schema: str | None = None, include_mean: bool = True,
):
    """Statistics over all leaves; with dry_run the list of leaves and touches nothing.

    With an output folder: reduced, stats and manifest.json are written there, stats and manifest
    only once all went well; with keep_leaves the applied values before the windows as well, a
    folder for each leaf. Missing leaves and models without a weight raise before any work.
    """
    if dry_run:
        return tree.leaves()
    check_data({"format": fmt, **({"region_dim": netcdf.get("region_dim")} if netcdf else {}), "denominator": denominator}, tree.subtract)
    if (model_weights is None) != (model_level is None) or (model_level is not None and (model_level not in sample_dims or model_level not in tree.levels)):
        raise ValueError("model weights need a level that is a sample dimension of the tree")
    if lost := missing_leaves(spark, tree):
        raise FileNotFoundError(f"{len(lost)} leaves are missing, such as {lost[:5]}")
    if model_weights is not None:
        regroup.attach_member_weights(spark.createDataFrame([(x,) for x in tree.expect[model_level]], f"`{model_level}` string"), model_weights, model_level)
    keys = list(artifact.schema.source.keys)
    if fmt == "netcdf" and len(keys) != 1:
        raise ValueError(f"netcdf leaves need sources of one key, not {keys}")
    options = {"schema": schema, "netcdf": netcdf, "region_col": keys[0], "kind": kind}
    data = read_leaves(spark, tree, fmt, **options)
    if tree.subtract:
        data = regroup.subtract(data, read_leaves(spark, tree, fmt, tree.subtract, **options), value_col)
    applied = apply_weights(artifact, data, kind=kind, weight=weight, data_version=data_version, value_col=value_col, denominator=denominator, coverage=coverage, allow_partial_coverage=allow_partial_coverage, record=f"{output}/coverage" if output else None).frame
    if output and keep_leaves:
        applied.write.mode("overwrite").partitionBy(*tree.levels).parquet(f"{output}/leaves")
        applied = spark.read.schema(applied.schema).parquet(f"{output}/leaves").select(*applied.columns)
    reduced = stats.window_means(applied, time_col=time_col, windows=windows, value_col=value_col)
    if model_weights is not None:
        reduced = regroup.attach_member_weights(reduced, model_weights, model_level)
    if output:
        reduced.write.mode("overwrite").parquet(f"{output}/reduced")
        reduced = spark.read.parquet(f"{output}/reduced")
    result = stats.pooled_statistics(reduced, sample_dims=sample_dims, value_col=value_col, quantiles=quantiles, include_mean=include_mean, weight_col="model_weight" if model_weights is not None else None)
    if output:
        write_product(spark, result, output, {"leaves": len(tree.leaves()), "levels": tree.expect, "kind": kind, "weight": weight, "windows": windows, "quantiles": list(quantiles), "sample_dims": sample_dims, "regions_version": artifact.regions_version, "source_version": artifact.source_version})
        result = spark.read.parquet(f"{output}/stats")
    return result


def write_product(spark: SparkSession, result: DataFrame, folder: str, account: dict, name: str = "stats") -> dict:
    """A result as Parquet and its account beside it, with the digest of what was written; the account comes last."""
    result.write.mode("overwrite").parquet(f"{folder}/{name}")
    account = account | {"rows": spark.read.parquet(f"{folder}/{name}").count(), "outputs": {name: artifacts.sha256(spark, f"{folder}/{name}")}}
    artifacts.write_text(spark, json.dumps(account, sort_keys=True, default=str, indent=1), f"{folder}/manifest.json")
    return account
