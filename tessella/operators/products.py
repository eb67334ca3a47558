"""What sector products add to applied values: measures, denominators, implied factors, crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio, reject_duplicates, require, sum0, value
from ..plans.schema import OutputSchema, SourceUnits, WeightsArtifact
from . import regroup

#: Fixed value: share of output that a wage factor stands for; factor / WAGE_SHARE is output per person.
WAGE_SHARE = 0.00487
#: Fixed value: gigajoules to the unit of energy levels in dollars.
ENERGY_DOLLARS = 0.0036


def valued(frame: DataFrame, *, effect: str, population: str | None = None, factor: str | None = None) -> DataFrame:
    """frame with {effect}_pop = effect times population, value = effect times factor, and gdp = factor / WAGE_SHARE, as far as the columns are given."""
    if population is not None:
        frame = frame.withColumn(f"{effect}_pop", value(effect) * value(population))
    if factor is not None:
        frame = frame.withColumn("value", value(effect) * value(factor)).withColumn("gdp", value(factor) / WAGE_SHARE)
    return frame


def joined_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which no key repeats on either side; repeats raise."""
    reject_duplicates(left, on, "the left side")
    reject_duplicates(right, on, "the right side")
    return left.join(right, on)


SCALES = {"per_100k": 1e5, "billions": 1e-9, "energy_dollars": 1 / ENERGY_DOLLARS, "percent": 100.0}


def scaled(c: str | Column, unit: str) -> Column:
    """A value in the unit that it is shown in."""
    if unit not in SCALES:
        raise ValueError(f"unit must be one of {sorted(SCALES)}, not {unit!r}")
    return value(c) * SCALES[unit]


def population(spark: SparkSession, path: str, years: tuple[int, int], *, id_col: str = "hierid", out: str = "pop", step: int = 5) -> DataFrame:
    """(id, year, pop) of a CSV of year, id and population behind lines of `#`, each row repeated for the years until the next step. The header, where there is one, is passed over; repeated rows raise."""
    base = spark.read.csv(path, comment="#", schema=f"year string, `{id_col}` string, `{out}` double").where(F.col("year").rlike("^[0-9]+$"))
    base = base.select(F.col("year").cast("int").alias("year"), id_col, out)
    reject_duplicates(base, ["year", id_col], path)
    return regroup.every_year(base, years, step).select(id_col, "year", out)


def residual_variance(spark: SparkSession, path: str) -> float:
    """The number on the line behind `residvcv`."""
    lines = [r[0].strip() for r in spark.read.text(path).collect()]
    if "residvcv" not in lines[:-1]:
        raise ValueError(f"{path} has no residvcv")
    return float(lines[lines.index("residvcv") + 1])


def amounts(spark: SparkSession, path: str, names: list[str], id_col: str = "hierid") -> DataFrame:
    """(id, amounts) of a CSV with a header; a repeated id raises."""
    df = spark.read.option("header", True).csv(path)
    require(df, [id_col, *names], path)
    reject_duplicates(df, [id_col], path)
    return df.select(id_col, *(F.col(c).cast("double").alias(c) for c in names))


def crop_artifacts(artifact: WeightsArtifact, areas: DataFrame, crops: list[str], name: str = "croparea") -> dict[str, WeightsArtifact]:
    """For each crop the weights of its area, split over targets by the land weights of an artifact; sources without any have no weight and method nan."""
    schema = artifact.schema
    keys, ids = list(schema.source.keys), list(schema.id_fields)
    out = {}
    for crop in crops:
        pairs = artifact.frame.select(*ids, *keys, "areawt")
        frame = regroup.split_area_weights(pairs, areas.select(*keys, F.col(crop).alias("amount")), source=keys, target=ids, land="areawt")
        none = areas.select(*keys, (value(crop) == 0).alias("_zero"))
        frame = frame.join(none, keys).select(*ids, *keys, F.when(~F.col("_zero"), F.col("wt")).alias(f"{name}wt"), F.when(~F.col("_zero"), F.col("raw")).alias(f"{name}_raw"), F.when(F.col("_zero"), "nan").otherwise("native").alias(f"{name}_method"))
        target = OutputSchema(tuple(ids), (name,), SourceUnits(tuple(keys)), "per_destination")
        out[crop] = WeightsArtifact(frame, target, artifact.regions_version, artifact.source_version, None, {"crop": crop, "allocation": "amounts split by the land weights of the base artifact"})
    return out


def members(frame: DataFrame, table: DataFrame, level: str) -> DataFrame:
    """Rows of the models that a weight table declares."""
    declared = table.select(regroup.member_key("model").alias("_k")).distinct()
    return frame.withColumn("_k", regroup.member_key(level)).join(F.broadcast(declared) if declared.limit(10_001).count() <= 10_000 else declared, "_k", "left_semi").drop("_k")


def inhabited(numerator: DataFrame, denominator: DataFrame, ids: list[str], *, pop: str = "pop") -> tuple[DataFrame, DataFrame]:
    """Both tables without targets whose denominator is 0 or missing in any year."""
    alive = denominator.groupBy(*ids).agg(F.min(F.coalesce(value(pop), F.lit(0.0))).alias("_p")).where("_p > 0").select(*ids)
    return numerator.join(alive, ids, "left_semi"), denominator.join(alive, ids, "left_semi")


def present(frame: DataFrame, value_col: str = "value") -> DataFrame:
    """Rows with a value."""
    return frame.where(value(value_col).isNotNull())


def implied_factor(pairs: DataFrame, ids: list[str], *, over: str, under: str, time_col: str = "year", least: float = 1e-9, spread: float = 1e-5) -> DataFrame:
    """(ids, time, factor): the median over draws of over / under where |under| > least; draws that differ from it by more than `spread` of it raise, holes are interpolated, and ends take the nearest value."""
    f = F.when(F.abs(value(under)) > least, value(over) / value(under))
    keys = [*ids, time_col]
    rows = pairs.select(*keys, f.alias("_f"))
    middle = rows.groupBy(*keys).agg(F.median("_f").alias("factor"))
    off = rows.join(middle, keys).agg(F.max(F.abs(F.col("_f") - F.col("factor")) / F.nullif(F.abs("factor"), F.lit(0.0)))).first()[0]
    if off is not None and off > spread:
        raise ValueError(f"the factor differs between draws by {off}")
    filled = regroup.interpolated(middle, ids, time_col, "factor")
    w = Window.partitionBy(*ids).orderBy(time_col)
    before = F.last("factor", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("factor", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return filled.withColumn("factor", F.coalesce("factor", before, after))


def widest(frame: DataFrame, source: list[str], target: list[str]) -> DataFrame:
    """The source unit on the most targets, with their number; ties go to the first by key."""
    return frame.groupBy(*source).agg(F.count_distinct(*target).alias("targets")).orderBy(F.desc("targets"), *source).limit(1)


def border_share(frame: DataFrame, column: str, home: str, value_col: str = "value") -> DataFrame:
    """One row: total, at_home, and the share of the total that lies elsewhere."""
    here = sum0(F.when(F.col(column) == home, value(value_col)))
    total = sum0(value(value_col))
    return frame.agg(total.alias("total"), here.alias("at_home"), (1 - ratio(here, total)).alias("elsewhere"))


def crosswalk(pairs: DataFrame, left: DataFrame, right: DataFrame, left_ids: list[str], right_ids: list[str], column: str) -> DataFrame:
    """Values of two versions of targets side by side, and their difference."""
    a = left.select(*left_ids, value(column).alias(f"{column}_left"))
    b = right.select(*right_ids, value(column).alias(f"{column}_right"))
    return pairs.select(*left_ids, *right_ids).join(a, left_ids).join(b, right_ids).withColumn("difference", F.col(f"{column}_right") - F.col(f"{column}_left"))


def named(frame: DataFrame, names: DataFrame, ids: list[str]) -> DataFrame:
    """frame with display names by the whole of its ids, which must not repeat in names; for after aggregation, never as keys."""
    reject_duplicates(names, ids, "the names")
    return frame.join(names, ids, "left")


def parent_code(c: str) -> Column:
    """The code of the unit above: a.b_v becomes a_v."""
    return F.regexp_replace(c, r"\.[^._]*_([^_]*)$", "_$1")


def wide(frame: DataFrame, ids: list[str], column: str, value_col: str = "value", values: list | None = None) -> DataFrame:
    """Rows as columns, one for each value of a column; give the values to save a pass."""
    return frame.groupBy(*ids).pivot(column, values).agg(F.first(value(value_col), True))
