"""Gradients of linear predictors on targets, and their delta-method errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ratio, require, sum0, value


def aggregate_gradient(weights: DataFrame, gradient: DataFrame, *, ids: list[str], keys: list[str], weight: str, scale: DataFrame | None = None, normalize: bool = False, check: bool = True) -> DataFrame:
    """(ids, gradient): the weighted sum of gradient(keys, gradient array) on each target, by scale(keys, scale) if given; normalize divides by the summed weight. Missing weights take no part."""
    require(weights, [*ids, *keys, f"{weight}wt"], "the weights")
    w = weights.select(*ids, *keys, value(f"{weight}wt").alias("_w")).where("_w IS NOT NULL")
    if check and (lost := gradient.select(*keys).distinct().join(w.select(*keys), keys, "left_anti").limit(5).collect()):
        raise ValueError(f"regions without weights, such as {[tuple(r) for r in lost]}")
    if scale is not None:
        w = w.join(scale.select(*keys, F.col("scale").cast("double")), keys).withColumn("_w", F.col("_w") * F.col("scale")).drop("scale")
    long = w.join(gradient, keys).select(*ids, "_w", F.posexplode("gradient").alias("_i", "_g"))
    total = sum0(F.col("_w") * F.col("_g").cast("double"))
    parts = long.groupBy(*ids, "_i").agg((ratio(total, sum0(F.col("_w"))) if normalize else total).alias("_v"))
    return parts.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("gradient"))


def delta_method(aggregated: DataFrame, vcv: list[list[float]], coefficients: list[float] | None = None, col: str = "gradient") -> DataFrame:
    """aggregated with sd = sqrt(g V g') and, given coefficients, mean = g b."""
    n = len(vcv)
    if any(len(row) != n for row in vcv) or (coefficients is not None and len(coefficients) != n):
        raise ValueError("the covariance must be square, and coefficients as many as its rows")
    lit = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    g = F.transform(F.col(col), lambda x: x.cast("double"))
    image = F.array(*(dot(g, lit(row)) for row in vcv))
    out = aggregated.withColumn("sd", F.sqrt(dot(g, image)))
    return out if coefficients is None else out.withColumn("mean", dot(g, lit(coefficients)))
