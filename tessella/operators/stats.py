"""Statistics over draws: window mean of each draw, then mean and quantiles of the pooled draws."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import reject_duplicates, require, value

RESERVED = re.compile(r"(^|_)(q\d{1,3}|mean)$")


class UnweightedModelWeightsWarning(UserWarning):
    """Models are pooled without the weights that ensembles of them usually have."""


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:g}"


def quantile_label(q: float) -> str:
    p = round(q * 100, 10)
    return f"q{int(p):02d}" if float(p).is_integer() else f"q{p:g}"


def window_label(lo: float, hi: float) -> str:
    return f"{number(lo)}-{number(hi)}"


def reject_statistics(df: DataFrame) -> None:
    bad = [c for c in df.columns if c == "statistic" or RESERVED.search(c)]
    if bad:
        raise ValueError(f"columns {bad} look like statistics; means and quantiles can't be pooled again")


def window_means(data: DataFrame, *, time_col: str, windows: list[tuple[float, float]], value_col: str = "value", window_col: str = "window", check: bool = True) -> DataFrame:
    """The mean over each window (bounds included) of every series; the time column gives way to the window's label. A row counts in each window that holds it."""
    require(data, [time_col, value_col], "the data")
    if window_col in data.columns:
        raise ValueError(f"the data have a column {window_col!r}: they seem reduced already")
    if not windows or any(lo > hi for lo, hi in windows):
        raise ValueError(f"windows must be pairs of a lower and an upper bound, not {windows}")
    labels = [window_label(*w) for w in windows]
    if len(set(labels)) < len(labels):
        raise ValueError(f"windows share a label: {labels}")
    keys = [c for c in data.columns if c not in (time_col, value_col)]
    if check:
        reject_duplicates(data, [*keys, time_col], "the data")
        seen = data.agg(F.min(time_col), F.max(time_col), *(F.count_if(F.col(time_col).between(lo, hi)) for lo, hi in windows)).first()
        empty = [x for x, n in zip(labels, seen[2:]) if not n]
        if empty:
            raise ValueError(f"no rows in windows {empty}; the data reach from {seen[0]} to {seen[1]}")
    inside = F.array_compact(F.array(*(F.when(F.col(time_col).between(lo, hi), F.lit(x)) for (lo, hi), x in zip(windows, labels))))
    long = data.where(F.col(time_col).between(min(w[0] for w in windows), max(w[1] for w in windows))).withColumn(window_col, F.explode(inside))
    return long.groupBy(*keys, window_col).agg(F.avg(value(value_col)).alias(value_col))


def _checked(data: DataFrame, sample_dims: list[str], value_col: str, quantiles: list[float], include_mean: bool, weight_col: str | None, check: bool) -> list[str]:
    require(data, [*sample_dims, value_col, *([weight_col] if weight_col else [])], "the data")
    reject_statistics(data)
    if clash := {"statistic", "_x", "_w"} & {*sample_dims, value_col, weight_col}:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError(f"quantiles must lie in [0, 1]: {quantiles}")
    if not quantiles and not include_mean:
        raise ValueError("no statistic is asked for")
    labels = [quantile_label(q) for q in quantiles]
    if len(set(labels)) < len(labels):
        raise ValueError(f"quantiles share a label: {labels}")
    if "gcm" in sample_dims and not weight_col:
        warnings.warn("models (gcm) are pooled with equal weights", UnweightedModelWeightsWarning, stacklevel=3)
    identity = [c for c in data.columns if c not in (*sample_dims, value_col, weight_col)]
    if check:
        reject_duplicates(data, [*identity, *sample_dims], "the draws")
        if weight_col:
            w = F.col(weight_col).cast("double")
            bad = data.agg(F.count_if(w.isNull() | F.isnan(w)), F.count_if((w < 0) | (w == float("inf")))).first()
            if bad[0] or bad[1]:
                raise ValueError(f"weights: {bad[0]} missing, {bad[1]} negative or infinite")
            if data.groupBy(*sample_dims).agg(F.count_distinct(weight_col).alias("n")).where("n > 1").limit(1).count():
                raise ValueError(f"{weight_col} varies within a draw")
    return identity


#: Ranges of values into which a table without identity is split, so that no task sorts it all.
RANGES = 64


def _bounds(data: DataFrame, x) -> list[float]:
    """Values that split the rows into ranges of about equal numbers."""
    found = data.agg(F.percentile_approx(x, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(1000))).first()[0]
    return sorted(set(found or []))


def _range_of(x, bounds: list[float]):
    """Number of bounds not above x."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(x >= F.lit(b), 1).otherwise(0)
    return out


def _split(steps: DataFrame, identity: list[str]) -> tuple[DataFrame, list[str]]:
    """steps(_x, _s) of a table without identity with its range `_r` and the weight before it `_before`; with identity as it is."""
    if identity:
        return steps, []
    ranged = steps.withColumn("_r", _range_of(F.col("_x"), _bounds(steps, F.col("_x"))))
    sums = ranged.groupBy("_r").agg(F.sum("_s").alias("_g"))
    before = sums.select("_r", F.coalesce(F.sum("_g").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_r"), ["_r"]


def _whole_percentiles(data: DataFrame, x, quantiles: list[float]) -> DataFrame:
    """One row (_m, _q): mean and interpolated quantiles of all rows, from the order statistics that the quantiles lie between."""
    rows = data.select(x.alias("_x")).where("_x IS NOT NULL")
    rows = rows.withColumn("_r", _range_of(F.col("_x"), _bounds(rows, F.col("_x"))))
    sums = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_g"))
    before = sums.select("_r", F.coalesce(F.sum("_g").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = rows.agg(F.avg("_x").alias("_m"), F.count("_x").alias("_n"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy("_x")) - 1).join(F.broadcast(before), "_r").withColumn("_k", F.col("_k") + F.col("_before")).crossJoin(F.broadcast(whole))
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in quantiles]
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_x")))
    found = ranked.agg(F.max("_n").alias("_n"), *(f(p).alias(f"_{s}{i}") for i, p in enumerate(place) for s, f in (("a", lambda p: at(F.floor(p))), ("b", lambda p: at(F.ceil(p))))))
    line = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(F.array(*line).alias("_q")).crossJoin(whole.select("_m"))


def pooled_statistics(data: DataFrame, *, sample_dims: list[str], value_col: str = "value", quantiles: tuple[float, ...] = (), include_mean: bool = True, weight_col: str | None = None, check: bool = True) -> DataFrame:
    """(identity, statistic, value): mean and quantiles over all draws of an identity, which is every column but the draw's.

    Unweighted quantiles interpolate linearly. A weighted quantile q is the largest value
    whose share of cumulated weight lies below q, or -inf if there is none; with equal
    weights the median is the ordinary one. Ties are taken in the order of the draw's columns.
    An identity without any value stays with missing statistics; with weights it raises.
    """
    quantiles = list(quantiles)
    identity = _checked(data, sample_dims, value_col, quantiles, include_mean, weight_col, check)
    x = value(value_col)
    labels = [*(["mean"] if include_mean else []), *map(quantile_label, quantiles)]
    if weight_col is None:
        if identity or not quantiles:
            parts = [F.avg(x).alias("_m"), *([F.percentile(x, F.array(*map(F.lit, quantiles))).alias("_q")] if quantiles else [])]
            wide = data.groupBy(*identity).agg(*parts)
        else:
            wide = _whole_percentiles(data, x, quantiles)
        cols = [*([F.col("_m")] if include_mean else []), *(F.col("_q")[i] for i in range(len(quantiles)))]
    else:
        rows = data.withColumn("_x", x).withColumn("_w", F.col(weight_col).cast("double"))
        held = F.sum(F.when(F.col("_x").isNotNull(), F.col("_w")))
        if check and (bad := rows.groupBy(*identity).agg(held.alias("_t")).where("_t IS NULL OR _t <= 0").limit(5).collect()):
            raise ValueError(f"weights sum to zero: no draw with a value carries any in {[tuple(r)[:-1] for r in bad]}")
        # draws of one value are one row: its weight, and that of the first of them, which is where the value's step begins
        steps = rows.where("_x IS NOT NULL").groupBy(*identity, "_x").agg(F.sum("_w").alias("_s"), F.min_by("_w", F.struct(*sample_dims)).alias("_f"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        steps, part = _split(steps, identity)
        by = Window.partitionBy(*identity, *part) if identity or part else Window.partitionBy(F.lit(0))
        within = F.coalesce(F.sum("_s").over(by.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        steps = steps.withColumn("_b", within + F.col("_before") if part else within)
        total = steps.groupBy(*identity).agg(F.sum("_s").alias("_t"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.try_divide(F.sum(F.col("_s") * F.col("_x")), F.sum("_s")).alias("_m"))
        steps = steps.drop("_lo", "_hi").join(total.select(*identity, "_t"), identity) if identity else steps.drop("_lo", "_hi").crossJoin(F.broadcast(total.select("_t")))
        reached = F.try_divide(F.col("_b") + F.col("_f"), F.col("_t"))
        parts = [F.coalesce(F.max(F.when(reached < q, F.col("_x"))), F.lit(float("-inf"))).alias(f"_q{i}") for i, q in enumerate(quantiles)]
        middle = F.percentile("_x", F.lit(0.5), F.col("_n")) if identity else F.lit(None).cast("double")
        wide = steps.groupBy(*identity).agg(middle.alias("_med"), *parts)
        wide = wide.join(total, identity) if identity else wide.crossJoin(total)
        if not identity and 0.5 in quantiles:
            wide = wide.drop("_med").crossJoin(_whole_percentiles(data, x, [0.5]).select(F.col("_q")[0].alias("_med")))
        cols = [*([F.col("_m")] if include_mean else []), *(F.when(F.col("_lo") == F.col("_hi"), F.col("_med")).otherwise(F.col(f"_q{i}")) if q == 0.5 else F.col(f"_q{i}") for i, q in enumerate(quantiles))]
    pairs = F.array(*(F.struct(F.lit(label).alias("statistic"), c.alias(value_col)) for label, c in zip(labels, cols)))
    return wide.select(*identity, F.explode(pairs).alias("_s")).select(*identity, "_s.statistic", f"_s.{value_col}")


def summarize_samples(data: DataFrame, *, sample_dims: list[str], time_col: str | None = None, window: tuple[float, float] | None = None, value_col: str = "value", quantiles: tuple[float, ...] = (), include_mean: bool = True, weight_col: str | None = None, check: bool = True) -> DataFrame:
    """Window mean of each draw, then statistics over the pooled draws."""
    if (time_col is None) != (window is None):
        raise ValueError("a time column needs a window, and a window a time column")
    if time_col is not None:
        reject_statistics(data)
        data = window_means(data, time_col=time_col, windows=[window], value_col=value_col, window_col="_window", check=check).drop("_window")
    return pooled_statistics(data, sample_dims=sample_dims, value_col=value_col, quantiles=quantiles, include_mean=include_mean, weight_col=weight_col, check=check)
