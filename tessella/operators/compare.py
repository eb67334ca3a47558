"""Comparing, merging and exporting weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import require, sum0_over, value
from ..plans.schema import OutputSchema
from . import validate


def differences(left: DataFrame, right: DataFrame, *, region: str, cell: list[str], weight: str, decimals: int | None = None) -> DataFrame:
    """(region, presence, max_diff): the largest difference of a weight on any cell of a region; cells of one side only count with 0 on the other. decimals rounds the cell columns before they meet."""
    side = lambda df, out: df.select(region, *(F.round(c, decimals).alias(c) if decimals is not None else F.col(c) for c in cell), value(f"{weight}wt").alias(out))
    both = side(left, "_a").withColumn("_l", F.lit(True)).join(side(right, "_b").withColumn("_r", F.lit(True)), [region, *cell], "full_outer")
    by = both.groupBy(region).agg(F.bool_or(F.coalesce("_l", F.lit(False))).alias("l"), F.bool_or(F.coalesce("_r", F.lit(False))).alias("r"), F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("max_diff"))
    return by.select(region, F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only").alias("presence"), "max_diff")


def comparison_report(found: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row: regions by presence, and median, 95th percentile, maximum and number above tolerance of the differences of regions on both sides."""
    d = F.when(F.col("presence") == "both", F.col("max_diff"))
    return found.agg(
        *(F.count_if(F.col("presence") == p).alias(p) for p in ("both", "left_only", "right_only")),
        F.percentile(d, F.lit(0.5)).alias("median_diff"), F.percentile(d, F.lit(0.95)).alias("p95_diff"), F.max(d).alias("largest_diff"), F.count_if(d > tolerance).alias("above"),
    )


def largest_cell(frame: DataFrame, *, region: str, cell: list[str], weight: str) -> DataFrame:
    """The cell of the greatest weight of each region; of ties the smallest cell."""
    order = [F.desc("_w"), *(F.asc(c) for c in cell)]
    rows = frame.select(region, *cell, value(f"{weight}wt").alias("_w")).where("_w IS NOT NULL")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(region).orderBy(*order))).where("_n = 1").select(region, *cell, F.col("_w").alias("weight"))


def displaced(left: DataFrame, right: DataFrame, *, region: str, cell: list[str], weight: str) -> DataFrame:
    """(region, displaced): whether the largest cells of both sides differ."""
    a = largest_cell(left, region=region, cell=cell, weight=weight)
    b = largest_cell(right, region=region, cell=cell, weight=weight).select(region, *(F.col(c).alias(f"_{c}") for c in cell))
    differs = F.lit(False)
    for c in cell:
        differs = differs | (F.col(c) != F.col(f"_{c}"))
    return a.join(b, region).select(region, differs.alias("displaced"))


def merge_weights(canonical: DataFrame, supplement: DataFrame, schema: OutputSchema, *, id_col: str, expected_total: int | None = None, source_labels: tuple[str, str] = ("canonical", "supplement"), tolerance: float = 1e-6, check: bool = True) -> DataFrame:
    """Both sets of weights with a `source` column. Their ids must not overlap, their number be as expected, and weights sum to one."""
    require(canonical, schema.columns, "the canonical weights")
    require(supplement, schema.columns, "the supplement")
    if check:
        if both := canonical.select(id_col).intersect(supplement.select(id_col)).limit(5).collect():
            raise ValueError(f"ids in both sets: {[r[0] for r in both]}")
    out = canonical.select(*schema.columns).withColumn("source", F.lit(source_labels[0])).unionByName(supplement.select(*schema.columns).withColumn("source", F.lit(source_labels[1])))
    if check:
        n = out.agg(F.count_distinct(id_col)).first()[0]
        if expected_total is not None and n != expected_total:
            raise ValueError(f"{n} ids, {expected_total} expected")
        if bad := validate.sum_to_one(out, schema, tolerance).limit(5).collect():
            raise ValueError(f"weights that don't sum to one: {[tuple(r) for r in bad]}")
    return out


def dense_ids(frame: DataFrame, id_col: str, out: str = "shpid") -> DataFrame:
    """frame with the rank from 0 of its id. Only distinct ids are ranked: within the ids that share their first characters, behind the counts of all such groups before."""
    ids = frame.select(id_col).distinct().withColumn("_p", F.substring(F.col(id_col).cast("string"), 1, 3))
    text = isinstance(frame.schema[id_col].dataType, T.StringType)
    if not text:
        ids = ids.withColumn("_p", F.floor(F.col(id_col) / 4096))
    sizes = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(id_col)) - 1
    ranked = ids.withColumn("_r", rank).join(before, "_p").select(id_col, (F.col("_r") + F.col("_before")).cast("long").alias(out))
    return frame.join(ranked, id_col)


def legacy_export(frame: DataFrame, *, id_col: str = "hierid", lon: str = "cell_lon", lat: str = "cell_lat", names: tuple[str, ...] = ("area", "pop", "crop")) -> DataFrame:
    """The wide layout of older readers: raw measures, their totals by region, weights, cell centres and a numeric region id."""
    w = Window.partitionBy(id_col)
    rows = dense_ids(frame.withColumn(id_col, F.col(id_col).cast("string")), id_col)
    raw = [F.coalesce(value(f"{n}_raw"), F.lit(0.0)).alias(n) for n in names]
    totals = [sum0_over(value(f"{n}_raw"), w).alias(f"{n}total") for n in names]
    return rows.select(id_col, F.col(lon).alias("pix_cent_x"), F.col(lat).alias("pix_cent_y"), *raw, *totals, *(F.col(f"{n}wt") for n in names), "shpid")


LEGACY_CELLS = ("hierid", "pix_cent_x", "pix_cent_y")


def write_legacy_csv(frame: DataFrame, folder: str, **options) -> str:
    """legacy_export() as CSV with a header, in the order of region and cell."""
    legacy_export(frame, **options).repartitionByRange(options.get("id_col", "hierid"), "pix_cent_x", "pix_cent_y").sortWithinPartitions(options.get("id_col", "hierid"), "pix_cent_x", "pix_cent_y").write.mode("overwrite").option("header", True).csv(folder)
    return folder


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """A legacy CSV: ids as text, shpid as an integer, all other columns as doubles."""
    df = spark.read.option("header", True).csv(path)
    kinds = {"hierid": "string", "shpid": "bigint"}
    return df.select(*(F.col(c).cast(kinds.get(c, "double")).alias(c) for c in df.columns))


def legacy_comparison(ours: DataFrame, legacy: DataFrame, *, weight: str = "crop", decimals: int = 4) -> tuple[DataFrame, DataFrame]:
    """(report, regions) of a weight in two legacy tables whose cells meet at rounded centres.

    A region is native on a side where any of its cells has a weight there. report counts
    regions by that, and has median, 95th percentile and maximum over regions native on both
    sides of their largest difference, with cells or weights of one side only as 0 on the other.
    regions has max_delta, both sides' cells of greatest weight (ties: the smallest cell) and
    whether they differ.
    """
    w = f"{weight}wt"
    for df in (ours, legacy):
        require(df, [*LEGACY_CELLS, w], "a legacy table")
    side = lambda df, out: df.select("hierid", *(F.round(c, decimals).alias(c) for c in LEGACY_CELLS[1:]), value(w).alias(out))
    both = side(ours, "_a").join(side(legacy, "_b"), list(LEGACY_CELLS), "full_outer")
    top = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("w"), (-F.col("pix_cent_x")).alias("x"), (-F.col("pix_cent_y")).alias("y"))))
    by = both.groupBy("hierid").agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("max_delta"), top("_a").alias("ta"), top("_b").alias("tb"))
    d = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("max_delta"))
    moved = (F.col("ta.x") != F.col("tb.x")) | (F.col("ta.y") != F.col("tb.y"))
    native = lambda x, y: F.count_if((F.col("a") > 0 if x else F.col("a") == 0) & (F.col("b") > 0 if y else F.col("b") == 0))
    report = by.agg(
        F.count(F.lit(1)).alias("regions"), native(1, 1).alias("both_native"), native(0, 0).alias("both_missing"), native(0, 1).alias("ours_missing"), native(1, 0).alias("legacy_missing"),
        F.percentile(d, F.lit(0.5)).alias("delta_median"), F.percentile(d, F.lit(0.95)).alias("delta_p95"), F.max(d).alias("delta_max"), F.count_if(d.isNotNull() & moved).alias("displaced"),
    )
    corner = lambda t, out: F.struct((-F.col(f"{t}.x")).alias("pix_cent_x"), (-F.col(f"{t}.y")).alias("pix_cent_y")).alias(out)
    regions = by.where("a > 0 AND b > 0").select("hierid", "max_delta", corner("ta", "ours_cell"), corner("tb", "legacy_cell"), moved.alias("displaced"))
    return report, regions


def top_by(frame: DataFrame, column: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows of the largest absolute value of a column; missing values never rank, ties go by `ties`."""
    size = F.abs(value(column))
    return frame.where(size.isNotNull()).orderBy(size.desc(), *ties).limit(k)


def canonical(frame: DataFrame, schema: OutputSchema) -> DataFrame:
    """The columns of a weights table in their order, the rows by ids and source keys."""
    return frame.select(*schema.columns).orderBy(*schema.id_fields, *schema.source.keys)


def reconciled(requested: DataFrame, known: DataFrame, ids: list[str], geometry: str = "geometry") -> DataFrame:
    """(ids, status): requested ids that are unknown, or known without a geometry (null_geometry)."""
    have = known.groupBy(*ids).agg(F.count(geometry).alias("_g"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_g") == 0, "null_geometry")
    return requested.select(*ids).distinct().join(have, ids, "left").withColumn("status", status).where("status IS NOT NULL").select(*ids, "status")


def keep_drop(frame: DataFrame, keep: dict[str, list] | None = None, drop: dict[str, list] | None = None) -> DataFrame:
    """Rows whose columns have one of the kept values, and none of the dropped; a missing value is never kept by a list nor dropped by one."""
    require(frame, [*(keep or {}), *(drop or {})], "the table")
    for c, values in (keep or {}).items():
        frame = frame.where(F.col(c).isin(values))
    for c, values in (drop or {}).items():
        frame = frame.where(~F.coalesce(F.col(c).isin(values), F.lit(False)))
    return frame


def find_ids(frame: DataFrame, column: str, pattern: str, limit: int = 50) -> DataFrame:
    """Distinct ids that match a LIKE pattern, in order, the first `limit` of them."""
    return frame.select(column).distinct().where(F.col(column).like(pattern)).orderBy(column).limit(limit)
