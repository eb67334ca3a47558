"""Checks on weights and on what applying them did."""

from __future__ import annotations

import json
import warnings
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import sum0, value
from ..plans.schema import OutputSchema


def sum_to_one(frame: DataFrame, schema: OutputSchema, tolerance: float = 1e-6) -> DataFrame:
    """(group, weight, total, deviation) of groups whose weights don't sum to one; groups without any weight are passed by."""
    sums = frame.groupBy(*schema.group).agg(*(F.sum(value(f"{w}wt")).alias(w) for w in schema.weights))
    long = sums.unpivot(list(schema.group), list(schema.weights), "weight", "total")
    return long.where(F.abs(F.col("total") - 1) > tolerance).withColumn("deviation", F.col("total") - 1)


def relative_error(a, b):
    """|a - b| over the larger of both sizes; 0 where both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


def mass_balance(source: DataFrame, target: DataFrame, group: list[str], source_value: str = "value", target_value: str = "value") -> DataFrame:
    """Totals on both sides of an application by group, with the relative error; a group on one side only compares with 0. Without groups: one row."""
    a = source.groupBy(*group).agg(sum0(value(source_value)).alias("source_total"))
    b = target.groupBy(*group).agg(sum0(value(target_value)).alias("target_total"))
    both = a.join(b, group, "full_outer") if group else a.crossJoin(b)
    both = both.select(*group, F.coalesce("source_total", F.lit(0.0)).alias("source_total"), F.coalesce("target_total", F.lit(0.0)).alias("target_total"))
    return both.withColumn("rel_error", relative_error(F.col("source_total"), F.col("target_total")))


STATUSES = ("unmatched", "zero_weight", "absent_from_data")


def source_coverage(weights: DataFrame, data: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, status) of source units that an application would leave out: unmatched (in data, not in weights), zero_weight (all weights 0 or missing), absent_from_data."""
    mass = weights.groupBy(*keys).agg(sum0(F.abs(value(weight))).alias("mass"))
    here = data.select(*keys).distinct().withColumn("in_data", F.lit(True))
    both = mass.withColumn("in_weights", F.lit(True)).join(here, keys, "full_outer")
    status = F.when(F.col("in_weights").isNull(), "unmatched").when(F.col("in_data").isNull(), "absent_from_data").when(F.col("mass") == 0, "zero_weight")
    return both.withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def enforce_coverage(found: DataFrame, policy: dict[str, str], record: str | None = None) -> dict[str, int]:
    """Counts by status; statuses whose policy isn't skip raise, all in one message. Skipped ones warn. With `record` the counts are written there as JSON first."""
    if unknown := set(policy) - set(STATUSES):
        raise ValueError(f"no status {sorted(unknown)}; there are {STATUSES}")
    keys = [c for c in found.columns if c != "status"]
    rows = found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last")).collect()
    counts = {r["status"]: r["n"] for r in rows}
    some = {r["status"]: [tuple(r["first"]), tuple(r["last"])] for r in rows}
    if record:
        body = json.dumps({"source_coverage": {k: {"n": n, "such_as": some[k], "policy": policy.get(k, "error")} for k, n in counts.items()}}, sort_keys=True, default=str)
        found.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(record)
    bad = {k: n for k, n in counts.items() if policy.get(k, "error") == "error"}
    if bad:
        raise ValueError(f"source units without a part in the result: {bad}, such as {({k: some[k] for k in bad})}; pass a policy of skip for a status to go on")
    for k, n in counts.items():
        warnings.warn(f"{n} source units are {k} and skipped, such as {some[k]}", stacklevel=2)
    return counts


def enforce(problems: DataFrame, what: str) -> None:
    """Raise where a table of (problem, n) has any."""
    if bad := {r["problem"]: r["n"] for r in problems.where("n > 0").collect()}:
        raise ValueError(f"{what}: {bad}")


def grid_problems(frame: DataFrame, n_ix: int, n_iy: int, id_fields: list[str], west: float = -180.0) -> DataFrame:
    """(problem, n) for rows with cell indices outside the grid, coordinates outside the half-open domain, or repeated keys."""
    rows = frame.agg(
        F.count_if((F.col("cell_ix") < 0) | (F.col("cell_ix") >= n_ix)).alias("ix"), F.count_if((F.col("cell_iy") < 0) | (F.col("cell_iy") >= n_iy)).alias("iy"),
        F.count_if((F.col("cell_lon") < west) | (F.col("cell_lon") >= west + 360)).alias("lon"), F.count_if((F.col("cell_lat") < -90) | (F.col("cell_lat") >= 90)).alias("lat"),
    )
    again = frame.groupBy(*id_fields, "cell_ix", "cell_iy").agg(F.count(F.lit(1)).alias("c")).agg(sum0(F.when(F.col("c") > 1, F.col("c"))).cast("long").alias("n"))
    return rows.unpivot([], ["ix", "iy", "lon", "lat"], "problem", "n").unionByName(again.select(F.lit("duplicate").alias("problem"), "n"))


def polygon_problems(frame: DataFrame, schema: OutputSchema, sources: DataFrame) -> DataFrame:
    """(problem, n): rows without keys, repeated pairs, sources that aren't known, known sources that are missing."""
    ids, keys = list(schema.id_fields), list(schema.source.keys)
    null = frame.agg(F.count_if(F.array_contains(F.array(*(F.col(c).isNull() for c in ids + keys)), True)).alias("n")).select(F.lit("null_key").alias("problem"), "n")
    again = frame.groupBy(*ids, *keys).agg(F.count(F.lit(1)).alias("c")).agg(sum0(F.when(F.col("c") > 1, F.col("c"))).cast("long").alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    known, used = sources.select(*keys).distinct(), frame.select(*keys).distinct()
    unknown = used.join(known, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_source").alias("problem"), "n")
    missing = known.join(used, keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_source").alias("problem"), "n")
    return null.unionByName(again).unionByName(unknown).unionByName(missing)
