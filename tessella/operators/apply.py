"""Applying weights to long tables: totals, averages and ratios on target units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import ratio, reject_duplicates, require, sum0, value
from ..plans.schema import WeightsArtifact
from . import validate

#: Weights up to this estimated size are sent to every task; larger ones are shuffled to the data.
BROADCAST_BYTES = 64 << 20


@dataclass
class AppliedResult:
    frame: DataFrame
    coverage: DataFrame
    balance: dict[str, DataFrame]


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where Spark's own estimate of its size is small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def joined(artifact: WeightsArtifact, data: DataFrame, weight: str, restrict: DataFrame | None = None) -> DataFrame:
    """Data rows with the ids and the weight `_w` of each target that their source unit has a weight for."""
    keys = list(artifact.schema.source.keys)
    w = artifact.frame.select(*artifact.schema.id_fields, *keys, value(f"{weight}wt").alias("_w"))
    if restrict is not None:
        w = w.join(restrict.select(*keys).distinct(), keys, "left_semi")
    return data.join(sized(w.where("_w IS NOT NULL")), keys)


def aggregated(rows: DataFrame, kind: str, groups: list[str], value_col: str = "value", denominator: str | None = None) -> DataFrame:
    """Weighted rows to targets: totals, averages over the units that have a value, or totals over totals."""
    x, w = value(value_col), F.col("_w")
    g = rows.groupBy(*groups)
    if kind == "extensive":
        return g.agg(sum0(w * x).alias(value_col))
    if kind == "intensive":
        return g.agg(ratio(sum0(w * x), sum0(F.when(x.isNotNull(), w))).alias(value_col))
    return g.agg(ratio(sum0(w * x), sum0(w * value(denominator))).alias(value_col))


def balances(artifact_rows: DataFrame, totals: DataFrame, keys: list[str], group: list[str], weight: str, columns: list[str]) -> DataFrame:
    """(column, group, source_total, target_total, rel_error) over the units that took part, which are those with a weight that isn't missing.

    totals(keys, group, columns) are sums by unit. What a unit gives to all targets together is
    its total times the sum of its weights, so neither side needs the data again.
    """
    mass = artifact_rows.where(value(f"{weight}wt").isNotNull()).groupBy(*keys).agg(F.sum(value(f"{weight}wt")).alias("_m"))
    used = totals.join(sized(mass), keys)
    long = used.select(*group, "_m", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("_v")) for c in columns))).alias("_c")).select(*group, "_m", "_c.*")
    sums = long.groupBy("column", *group).agg(sum0(F.col("_v")).alias("source_total"), sum0(F.col("_v") * F.col("_m")).alias("target_total"))
    return sums.withColumn("rel_error", validate.relative_error(F.col("source_total"), F.col("target_total")))


def apply_weights(
    artifact: WeightsArtifact, data: DataFrame, *, kind: str, weight: str, data_version: str | None, value_col: str = "value", denominator: str | None = None, group_col: str | None = None,
    restrict_to_sources: DataFrame | None = None, allow_partial_coverage: bool = False, coverage: dict[str, str] | None = None, tolerance: float = 1e-6, record: str | None = None,
) -> AppliedResult:
    """Target-level values of a long table with one row per source unit and dimensions.

    Every column beside the source keys, the value and the denominator is a dimension.
    kind says what the value is: extensive (a total to be split), intensive (an average) or
    ratio (value over denominator, both totals). Versions must agree, rows must be unique,
    units that would be left out raise unless the coverage policy says skip (with `record`,
    a path, their counts are written there before), and totals must balance over the units
    that took part: units whose weights are all 0 are among them, so skipping such units
    loses their totals and raises here.

    The data are read for the hashes of their keys, for sums by unit, from which coverage and
    balance follow, and for the result.
    """
    schema, keys = artifact.schema, list(artifact.schema.source.keys)
    schema.check_kind(kind)
    if artifact.source_version is None:
        raise ValueError("the weights don't state the version of their source units")
    if data_version is None or data_version != artifact.source_version:
        raise ValueError(f"data are of version {data_version!r}, weights of {artifact.source_version!r}")
    if artifact.partial_coverage and not allow_partial_coverage:
        raise ValueError(f"{artifact.partial_coverage} source units are only partly covered; allow_partial_coverage=True accepts that")
    if (kind == "ratio") != (denominator is not None):
        raise ValueError("a ratio needs a denominator, and only a ratio takes one")
    if weight not in schema.weights:
        raise ValueError(f"no weight {weight!r}; there are {list(schema.weights)}")
    group = [group_col] if group_col else []
    columns = [value_col, *([denominator] if denominator else [])]
    require(data, [*keys, *columns, *group], "the data")
    dims = [c for c in data.columns if c not in (*keys, *columns)]
    reject_duplicates(data, [*keys, *dims], "the data")
    w = artifact.frame
    if restrict_to_sources is not None:
        w = w.join(restrict_to_sources.select(*keys).distinct(), keys, "left_semi")
    units = data.groupBy(*keys, *group).agg(*(sum0(value(c)).alias(c) for c in columns)).persist(StorageLevel.DISK_ONLY)
    try:
        found = validate.source_coverage(w, units, keys, f"{weight}wt")
        validate.enforce_coverage(found, coverage or {}, record)
        balance = {}
        if kind != "intensive":
            rows = balances(w, units, keys, group, weight, columns).collect()
            if bad := [r.asDict() for r in rows if r["rel_error"] > tolerance]:
                raise ValueError(f"totals don't balance: {bad[:5]}")
            if not group:
                balance = {c: data.sparkSession.createDataFrame([(r["source_total"], r["target_total"], r["rel_error"]) for r in rows if r["column"] == c] or [(0.0, 0.0, 0.0)], "source_total double, target_total double, rel_error double") for c in columns}
            else:
                kind_of = data.schema[group_col].dataType
                shape = T.StructType([T.StructField(group_col, kind_of), *(T.StructField(n, T.DoubleType()) for n in ("source_total", "target_total", "rel_error"))])
                balance = {c: data.sparkSession.createDataFrame([(r[group_col], r["source_total"], r["target_total"], r["rel_error"]) for r in rows if r["column"] == c], shape) for c in columns}
    finally:
        units.unpersist()
    found = validate.source_coverage(w, data, keys, f"{weight}wt")
    rows = joined(artifact, data, weight, restrict_to_sources)
    return AppliedResult(aggregated(rows, kind, [*schema.id_fields, *dims], value_col, denominator), found, balance)
