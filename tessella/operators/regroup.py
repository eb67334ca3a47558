"""Coarser targets, sibling differences, member weights and derived measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio, reject_duplicates, sum0, sum0_over, value


def regroup_sum(frame: DataFrame, groups: list[str], value_col: str = "value") -> DataFrame:
    """Totals on coarser groups."""
    return frame.groupBy(*groups).agg(sum0(value(value_col)).alias(value_col))


def regroup_mean(frame: DataFrame, groups: list[str], mass: str, value_col: str = "value") -> DataFrame:
    """Averages on coarser groups, weighted by a mass over the rows with a value."""
    x = value(value_col)
    return frame.groupBy(*groups).agg(ratio(sum0(x * value(mass)), sum0(F.when(x.isNotNull(), value(mass)))).alias(value_col))


def ratio_of(numerator: DataFrame, denominator: DataFrame, on: list[str], value_col: str = "value", out: str = "value", check: bool = True) -> DataFrame:
    """Totals over totals of another table, one row to one; rows that repeat a key raise."""
    if check:
        reject_duplicates(numerator, on, "the numerator")
        reject_duplicates(denominator, on, "the denominator")
    d = denominator.select(*on, value(value_col).alias("_d"))
    return numerator.join(d, on).select(*on, ratio(value(value_col), F.col("_d")).alias(out))


def ratio_of_means(frame: DataFrame, groups: list[str], num: str, den: str, out: str = "value") -> DataFrame:
    """Mean over mean, which is not the mean of ratios."""
    return frame.groupBy(*groups).agg(ratio(F.avg(value(num)), F.avg(value(den))).alias(out))


def subtract(left: DataFrame, right: DataFrame, value_col: str = "value", check: bool = True) -> DataFrame:
    """left minus right, matched one to one on all other columns; rows on one side only raise."""
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    keys = [c for c in left.columns if c != value_col]
    l, r = left.alias("l"), right.alias("r")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    if check:
        reject_duplicates(left, keys, "the left side")
        reject_duplicates(right, keys, "the right side")
        lost = l.join(r, on, "left_anti").limit(3).collect() + r.join(l, on, "left_anti").limit(3).collect()
        if lost:
            raise ValueError(f"rows without a partner, such as {[tuple(x) for x in lost]}")
    return l.join(r, on).select(*(F.col(f"l.{c}") for c in keys), (value(F.col(f"l.{value_col}")) - value(F.col(f"r.{value_col}"))).alias(value_col))


def member_key(c: str):
    """The name that model tables and leaves share: without stars and the surrogate prefix, in lower case."""
    return F.lower(F.replace(F.replace(F.col(c), F.lit("*")), F.lit("surrogate_")))


def attach_member_weights(frame: DataFrame, table: DataFrame, level: str, weight_col: str = "model_weight", check: bool = True) -> DataFrame:
    """frame with the weight of its model; a model without a weight raises."""
    t = table.select(member_key("model").alias("_k"), F.col("weight").cast("double").alias(weight_col))
    if check:
        reject_duplicates(t, ["_k"], "the model weights")
        lost = frame.select(level).distinct().withColumn("_k", member_key(level)).join(t, "_k", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"models without a weight: {[r[level] for r in lost]}")
    return frame.withColumn("_k", member_key(level)).join(F.broadcast(t) if t.limit(10_001).count() <= 10_000 else t, "_k").drop("_k")


def percent_change(frame: DataFrame, *, series: list[str], time_col: str, base: tuple[float, float], residual_variance: float, value_col: str = "value") -> DataFrame:
    """100 times the level exp(x) exp(v / 2) - 1, less its mean over the base period of the same series."""
    level = F.exp(value(value_col)) * F.exp(F.lit(0.5 * residual_variance)) - 1
    w = Window.partitionBy(*series)
    rows = frame.withColumn("_l", level)
    return rows.withColumn(value_col, 100 * (F.col("_l") - F.avg(F.when(F.col(time_col).between(*base), F.col("_l"))).over(w))).drop("_l")


def split_area_weights(pairs: DataFrame, areas: DataFrame, *, source: list[str], target: list[str], land: str = "area_raw", amount: str = "amount", check: bool = True) -> DataFrame:
    """Weights on targets from an amount of each source unit, split by its land area: raw is the split amount, wt its share of the target's total, NULL where that is 0."""
    if check and (lost := pairs.select(*source).distinct().join(areas, source, "left_anti").limit(5).collect()):
        raise ValueError(f"units without an amount: {[tuple(r) for r in lost]}")
    whole = sum0_over(value(land), Window.partitionBy(*source))
    rows = pairs.join(areas.select(*source, value(amount).alias("_a")), source).withColumn("raw", ratio(F.col("_a") * value(land), whole))
    return rows.withColumn("wt", ratio(F.col("raw"), sum0_over(F.col("raw"), Window.partitionBy(*target)))).drop("_a")


def every_year(steps: DataFrame, years: tuple[int, int], step: int = 5, year_col: str = "year") -> DataFrame:
    """A series given each `step` years, repeated for the years until the next."""
    spark = steps.sparkSession
    y = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("_y"), (F.col("id") - F.col("id") % step).cast("int").alias(year_col))
    return steps.withColumn(year_col, F.col(year_col).cast("int")).join(F.broadcast(y), year_col).drop(year_col).withColumnRenamed("_y", year_col)


def best_target(frame: DataFrame, source: list[str], target: list[str], weight: str) -> DataFrame:
    """The target of the greatest weight of each source unit; ties go to the first target."""
    w = Window.partitionBy(*source).orderBy(F.desc(weight), *target)
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*source, *target, weight)


def interpolated(frame: DataFrame, series: list[str], time_col: str, value_col: str) -> DataFrame:
    """Missing values on the line between the nearest known ones of the series; ends stay missing."""
    w = Window.partitionBy(*series).orderBy(time_col)
    x, t = value(value_col), F.col(time_col).cast("double")
    known = F.when(x.isNotNull(), F.struct(t.alias("t"), x.alias("x")))
    rows = frame.withColumn("_a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (t - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    return rows.withColumn(value_col, F.coalesce(x, line)).drop("_a", "_b")
