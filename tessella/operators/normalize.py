"""Raw measures to weights, with fallbacks for groups without any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import sum0_over, value

POLICIES = ("area", "zero", "error", "nan")


def native_weights(cells: DataFrame, group: list[str], name: str, raw: str, strict: bool = True) -> DataFrame:
    """cells with {name}wt = raw / group total, {name}_raw and {name}_method native; strict: a total not above 0 raises."""
    total = sum0_over(value(raw), Window.partitionBy(*group))
    out = cells.withColumn("_t", total).withColumn(f"{name}_raw", value(raw)).withColumn(f"{name}wt", F.when(F.col("_t") > 0, F.col(f"{name}_raw") / F.col("_t"))).withColumn(f"{name}_method", F.lit("native"))
    if strict and (bad := out.where("_t <= 0").select(*group).distinct().limit(5).collect()):
        raise ValueError(f"{name}: groups without a positive total, such as {[tuple(r) for r in bad]}")
    return out.drop("_t")


def with_fallback(spine: DataFrame, raw: DataFrame, keys: list[str], group: list[str], name: str, policy: str = "area", raw_col: str = "raw", area: str = "areawt", strict: bool = True) -> DataFrame:
    """Every row of the area spine with the weight `name`; groups whose raw total isn't above 0 follow the policy.

    raw(keys, raw_col) may lack rows, which count as 0, but no group of its own. area: the
    spine's area weight; a group without area raises under it.
    """
    if policy not in POLICIES:
        raise ValueError(f"fallback must be one of {POLICIES}, not {policy!r}")
    if strict:
        lost = raw.select(*group).distinct().join(spine.select(*group).distinct(), group, "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"{name}: groups that the area spine lacks, such as {[tuple(r) for r in lost]}")
    joined = spine.join(raw.select(*keys, value(raw_col).alias("_x")), keys, "left").withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    w = Window.partitionBy(*group)
    joined = joined.withColumn("_t", F.sum("_x").over(w)).withColumn("_a", sum0_over(value(area), w))
    if strict:
        if policy == "error" and (bad := joined.where("_t <= 0").select(*group).distinct().limit(5).collect()):
            raise ValueError(f"{name}: no positive total in {[tuple(r) for r in bad]}")
        if bad := joined.where("_t <= 0 AND _a <= 0").select(*group).distinct().limit(5).collect():
            raise ValueError(f"{name}: neither a total nor an area in {[tuple(r) for r in bad]}")
    other = {"area": F.col(area).cast("double"), "zero": F.lit(0.0), "nan": F.lit(None).cast("double"), "error": F.lit(None).cast("double")}[policy]
    label = {"area": "area_fallback"}.get(policy, policy)
    native = F.col("_t") > 0
    return joined.withColumn(f"{name}wt", F.when(native, F.col("_x") / F.col("_t")).otherwise(other)).withColumn(f"{name}_raw", F.col("_x")).withColumn(f"{name}_method", F.when(native, "native").otherwise(label)).drop("_x", "_t", "_a")


def method_counts(frame: DataFrame, group: list[str], name: str) -> DataFrame:
    """(method, n): groups by the method of their weights."""
    return frame.groupBy(*group).agg(F.max(f"{name}_method").alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def dominant_fallback(frame: DataFrame, group: list[str], name: str, share: float = 0.05, least: int = 5) -> bool:
    """Whether so many groups fell back that the policy should be chosen on purpose."""
    counts = {r["method"]: r["n"] for r in method_counts(frame, group, name).collect()}
    total = sum(counts.values())
    return total - counts.get("native", 0) >= max(least, int(share * total))


def combined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames of single weights as one, on the union of their keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full_outer")
    return out
