"""Weights as files: Parquet or CSV beside a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..plans.schema import GRID_CELLS, OutputSchema, SourceUnits, WeightsArtifact

FORMATS = ("parquet", "csv", "both")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file, or of the files of a folder in the order of their names, read in blocks through Spark's file systems."""
    fs, p = _fs(spark, path)
    files = [p] if fs.getFileStatus(p).isFile() else sorted((f.getPath() for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda x: x.getName())
    total = spark._jvm.org.apache.commons.codec.digest.DigestUtils.getSha256Digest()
    for f in files:
        stream = fs.open(f)
        try:
            spark._jvm.org.apache.commons.codec.digest.DigestUtils.updateDigest(total, stream)
        finally:
            stream.close()
    return bytes(x % 256 for x in total.digest()).hex()


def single_file(spark: SparkSession, df: DataFrame, path: str, fmt: str) -> str:
    """df as one file instead of a folder of parts, and its digest. For results that are small by nature."""
    parts = f"{path}.parts"
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(parts) if fmt == "csv" else w.parquet(parts)
    fs, p = _fs(spark, parts)
    (one,) = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")]
    _, to = _fs(spark, path)
    fs.delete(to, True)
    if not fs.rename(one, to):
        raise OSError(f"{one} can't be moved to {path}")
    fs.delete(p, True)
    return sha256(spark, path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, or the parts of a folder; hidden names are read like others."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_artifact(artifact: WeightsArtifact, folder: str, fmt: str = "parquet", stem: str = "weights", single: bool = False, inputs: dict[str, str] | None = None) -> list[str]:
    """Write the weights and stem.manifest.json to any path that Spark writes; returns the paths of the weights.

    The manifest holds the schema, the versions, digests of the configuration, of the outputs
    and of the named input files. With `single` each output is one file, sorted by its keys.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    s, out, spark, sums = artifact.schema, [], artifact.frame.sparkSession, {}
    for f in ("parquet", "csv") if fmt == "both" else (fmt,):
        path = f"{folder}/{stem}.{f}"
        if single:
            sums[f"{stem}.{f}"] = single_file(spark, artifact.frame.select(*s.columns).orderBy(*s.id_fields, *s.source.keys), path, f)
        else:
            w = artifact.frame.write.mode("overwrite")
            w.option("header", True).csv(path) if f == "csv" else w.parquet(path)
            sums[f"{stem}.{f}"] = sha256(spark, path)
        out.append(path)
    info = artifact.manifest | {"id_fields": list(s.id_fields), "weight_names": list(s.weights), "source_key_columns": list(s.source.keys), "source_mode": "grid" if s.source == GRID_CELLS else "polygon", "normalization": s.normalization, "regions_version": artifact.regions_version, "source_version": artifact.source_version, "partial_coverage": artifact.partial_coverage}
    info["config_sha256"] = hashlib.sha256(json.dumps(info, sort_keys=True, default=str).encode()).hexdigest()
    info["outputs"] = sums
    info["inputs"] = {k: sha256(spark, v) for k, v in (inputs or {}).items()}
    write_text(spark, json.dumps(info, sort_keys=True, default=str, indent=1), f"{folder}/{stem}.manifest.json")
    return out


def load_artifact(spark: SparkSession, folder: str, stem: str = "weights") -> WeightsArtifact:
    """Read what write_artifact() wrote. A manifest without schema raises; types of id columns stay as they are in the file. Where there is no Parquet, the CSV is read."""
    info = json.loads(read_text(spark, f"{folder}/{stem}.manifest.json"))
    lost = [k for k in ("id_fields", "source_key_columns", "weight_names") if not info.get(k)]
    if lost:
        raise ValueError(f"the manifest lacks {lost}")
    source = GRID_CELLS if info.get("source_mode") == "grid" else SourceUnits(tuple(info["source_key_columns"]))
    schema = OutputSchema(tuple(info["id_fields"]), tuple(info["weight_names"]), source, info.get("normalization") or "per_destination")
    fs, p = _fs(spark, f"{folder}/{stem}.parquet")
    frame = spark.read.parquet(f"{folder}/{stem}.parquet") if fs.exists(p) else spark.read.schema(schema.struct).option("header", True).csv(f"{folder}/{stem}.csv")
    partial = info.get("partial_coverage")
    return WeightsArtifact(frame, schema, info.get("regions_version"), info.get("source_version"), partial.get("count") if isinstance(partial, dict) else partial, info)


def load_manifest(spark: SparkSession, folder: str, stem: str = "weights") -> dict:
    return json.loads(read_text(spark, f"{folder}/{stem}.manifest.json"))


def load_canonical(spark: SparkSession, path: str, schema: OutputSchema) -> DataFrame:
    """A weights table from any path that Spark reads, checked against its schema and with its columns in order."""
    df = spark.read.parquet(path)
    schema.validate(df)
    return df.select(*schema.columns)


def model_weights(spark: SparkSession, path: str) -> DataFrame:
    """(model, weight) of a tab-separated table with a header."""
    df = spark.read.csv(path, sep="\t", header=True)
    lost = [c for c in ("model", "weight") if c not in df.columns]
    if lost:
        raise ValueError(f"the model table lacks {lost}")
    return df.selectExpr("model", "cast(weight as double) AS weight")
