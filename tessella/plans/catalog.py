"""Queries over the driver's tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as ap
from ..operators import compare, gradients, normalize, polygons, products, regroup, stats, validate, zonal
from ..operators import grid as gr
from ..sources import netcdf
from . import generate
from .schema import OutputSchema, SourceUnits, WeightsArtifact

OVERLAP = """SELECT n_regionkey, c_nationkey, l_suppkey, CAST(count(*) AS DOUBLE) AS area_raw,
 sum(CASE WHEN l_quantity > 45 AND s_acctbal > 0 AND c_acctbal > 0 THEN l_quantity ELSE CAST(0 AS DOUBLE) END) AS pop_raw
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_nationkey, l_suppkey"""
DATA = """SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS value, sum(l_quantity) AS den FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_returnflag"""
DRAWS = """SELECT c_nationkey, o_orderpriority, CAST(month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority, month(o_orderdate), year(o_orderdate)"""
MODELS = "SELECT * FROM (VALUES ('*1-URGENT', 0.3701), ('2-High*', 0.2203), ('3-medium', 0.1907), ('4-NOT SPECIFIED', 0.1303), ('surrogate_5-low', 0.0886)) AS t(model, weight)"
POINTS = """SELECT CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 104729) % 18000 AS DOUBLE) / 100 - 90 AS lat, c_acctbal AS value FROM {customer}"""
BOXES = """SELECT n_nationkey, CAST((n_nationkey * 37) % 300 AS DOUBLE) - 170.25 AS x0, CAST((n_nationkey * 53) % 140 AS DOUBLE) - 80.5 AS y0, CAST((n_nationkey * 37) % 300 AS DOUBLE) - 170.25 + 3 + n_nationkey % 5 * 1.5 AS x1, CAST((n_nationkey * 53) % 140 AS DOUBLE) - 80.5 + 2 + n_nationkey % 3 * 2.25 AS y1 FROM {nation}"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
IDS = ["n_regionkey", "c_nationkey"]
SOURCE = SourceUnits(("l_suppkey",))
GRID = gr.GridSpec(1.0)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in text})


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def weights(spark, d, norm="per_source", strict=False) -> WeightsArtifact:
    group = ["l_suppkey"] if norm == "per_source" else IDS
    w = normalize.native_weights(sql(spark, d, OVERLAP), group, "area", "area_raw", strict=strict)
    return WeightsArtifact(w, OutputSchema(tuple(IDS), ("area",), SOURCE, norm), "targets-v1", "units-v1")


_W = {n: f"WITH w AS (SELECT *, area_raw / sum(area_raw) OVER (PARTITION BY {g}) AS areawt FROM ({duck(OVERLAP)})), d AS ({duck(DATA)}) " for n, g in (("per_source", "l_suppkey"), ("per_destination", "n_regionkey, c_nationkey"))}
_GRP = {"per_source": "l_suppkey", "per_destination": "n_regionkey, c_nationkey"}
_REG: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None):
    def add(f):
        _REG[name] = (f, oracle)
        return f

    return add


def _native(norm):
    def run(spark, d):
        return rounded(weights(spark, d, norm).frame.select(*IDS, "l_suppkey", "areawt", "area_raw", "area_method"), "areawt", n=9)

    query(f"weights_native_{norm}", _W[norm] + "SELECT n_regionkey, c_nationkey, l_suppkey, round(areawt, 9) AS areawt, area_raw, 'native' AS area_method FROM w")(run)


for _n in ("per_source", "per_destination"):
    _native(_n)


def fallback(spark, d, policy, norm="per_source", strict=False):
    frame = weights(spark, d, norm, strict).frame
    raw = frame.where("pop_raw > 0").select(*IDS, "l_suppkey", F.col("pop_raw").alias("raw"))
    group = ["l_suppkey"] if norm == "per_source" else IDS
    return normalize.with_fallback(frame.drop("pop_raw"), raw, [*IDS, "l_suppkey"], group, "pop", policy, strict=strict)


def _fallback(policy, other, label, guarded=False):
    def run(spark, d):
        return rounded(fallback(spark, d, policy, strict=guarded).select(*IDS, "l_suppkey", "popwt", "pop_raw", "pop_method"), "popwt", n=9)

    text = _W["per_source"] + f"SELECT n_regionkey, c_nationkey, l_suppkey, round(CASE WHEN t > 0 THEN pop_raw / t ELSE {other} END, 9) AS popwt, pop_raw, CASE WHEN t > 0 THEN 'native' ELSE '{label}' END AS pop_method FROM (SELECT *, sum(pop_raw) OVER (PARTITION BY l_suppkey) AS t FROM w)"
    query(f"weights_{'guarded' if guarded else 'fallback'}_{policy}", text)(run)


for _p, _o, _l in (("area", "areawt", "area_fallback"), ("zero", "CAST(0 AS DOUBLE)", "zero"), ("nan", "CAST(NULL AS DOUBLE)", "nan")):
    _fallback(_p, _o, _l)
_fallback("area", "areawt", "area_fallback", guarded=True)


@query("fallback_method_counts", _W["per_source"] + "SELECT method, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_suppkey, CASE WHEN sum(pop_raw) > 0 THEN 'native' ELSE 'area_fallback' END AS method FROM w GROUP BY l_suppkey) GROUP BY method")
def _(spark, d):
    return normalize.method_counts(fallback(spark, d, "area"), ["l_suppkey"], "pop")


@query("sum_to_one_report", _W["per_source"] + "SELECT l_suppkey, 'pop' AS weight, CAST(0 AS DOUBLE) AS total, CAST(-1 AS DOUBLE) AS deviation FROM w GROUP BY l_suppkey HAVING sum(pop_raw) <= 0")
def _(spark, d):
    frame = fallback(spark, d, "zero")
    return validate.sum_to_one(frame, OutputSchema(tuple(IDS), ("area", "pop"), SOURCE, "per_source"))


def _apply(kind, norm, expr):
    def run(spark, d):
        a = weights(spark, d, norm)
        rows = ap.joined(a, sql(spark, d, DATA), "area")
        out = ap.aggregated(rows, kind, [*IDS, "year", "l_returnflag"], "value", "den" if kind == "ratio" else None)
        return rounded(out, "value", n=4)

    query(f"apply_{kind}", _W[norm] + f"SELECT n_regionkey, c_nationkey, year, l_returnflag, round({expr}, 4) AS value FROM w JOIN d USING (l_suppkey) GROUP BY ALL")(run)


_apply("extensive", "per_source", "sum(areawt * value)")
_apply("intensive", "per_destination", "sum(areawt * value) / sum(areawt)")
_apply("ratio", "per_source", "sum(areawt * value) / sum(areawt * den)")


@query("apply_checked", _W["per_source"] + "SELECT n_regionkey, c_nationkey, year, l_returnflag, round(sum(areawt * value), 4) AS value FROM w JOIN d USING (l_suppkey) GROUP BY ALL")
def _(spark, d):
    got = ap.apply_weights(weights(spark, d), sql(spark, d, DATA).drop("den"), kind="extensive", weight="area", data_version="units-v1", coverage={"absent_from_data": "skip", "unmatched": "skip"})
    return rounded(got.frame, "value", n=4)


@query("apply_restricted", _W["per_source"] + "SELECT n_regionkey, c_nationkey, year, l_returnflag, round(sum(areawt * value), 4) AS value FROM w JOIN d USING (l_suppkey) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL")
def _(spark, d):
    units = sql(spark, d, "SELECT s_suppkey AS l_suppkey FROM {supplier} WHERE s_acctbal > 0")
    return rounded(ap.aggregated(ap.joined(weights(spark, d), sql(spark, d, DATA), "area", units), "extensive", [*IDS, "year", "l_returnflag"]), "value", n=4)


@query("source_coverage", "WITH w AS (" + duck(OVERLAP) + "), m AS (SELECT l_suppkey, sum(pop_raw) AS mass FROM w JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 6000 GROUP BY 1), h AS (SELECT s_suppkey AS l_suppkey FROM supplier WHERE length(s_name) > 0 AND s_acctbal > -500) SELECT l_suppkey, CASE WHEN m.mass IS NULL THEN 'unmatched' WHEN NOT here THEN 'absent_from_data' ELSE 'zero_weight' END AS status FROM (SELECT coalesce(m.l_suppkey, h.l_suppkey) AS l_suppkey, mass, h.l_suppkey IS NOT NULL AS here FROM m FULL JOIN h ON m.l_suppkey = h.l_suppkey) AS m WHERE mass IS NULL OR NOT here OR mass = 0")
def _(spark, d):
    w = sql(spark, d, OVERLAP).join(sql(spark, d, "SELECT s_suppkey AS l_suppkey FROM {supplier} WHERE s_acctbal < 6000"), "l_suppkey", "left_semi")
    return validate.source_coverage(w, sql(spark, d, "SELECT s_suppkey AS l_suppkey FROM {supplier} WHERE s_acctbal > -500"), ["l_suppkey"], "pop_raw")


@query("mass_balance_by_group", _W["per_source"] + "SELECT a.l_returnflag, round(s, 2) AS source_total, round(t, 2) AS target_total, round(abs(s - t) / greatest(abs(s), abs(t)), 6) AS rel_error FROM (SELECT l_returnflag, sum(value) AS s FROM d GROUP BY 1) a JOIN (SELECT l_returnflag, sum(areawt * value) AS t FROM w JOIN d USING (l_suppkey) WHERE area_raw >= 20 GROUP BY 1) b USING (l_returnflag)")
def _(spark, d):
    data, w = sql(spark, d, DATA), weights(spark, d)
    w.frame, _lost = gr.large_segments(w.frame, ["l_suppkey"], 20.0)
    got = ap.aggregated(ap.joined(w, data, "area"), "extensive", [*IDS, "l_returnflag"])
    return rounded(rounded(validate.mass_balance(data, got, ["l_returnflag"]), "source_total", "target_total", n=2), "rel_error")


@query("apply_balance", _W["per_source"] + "SELECT l_returnflag, round(sum(value), 2) AS source_total, round(sum(value), 2) AS target_total, CAST(0 AS DOUBLE) AS rel_error FROM d WHERE l_suppkey IN (SELECT l_suppkey FROM w) GROUP BY 1")
def _(spark, d):
    got = ap.apply_weights(weights(spark, d, strict=True), sql(spark, d, DATA).drop("den"), kind="extensive", weight="area", data_version="units-v1", group_col="l_returnflag", coverage={"absent_from_data": "skip", "unmatched": "skip"})
    return rounded(rounded(got.balance["value"], "source_total", "target_total", n=2), "rel_error")


@query("member_weight_constancy", "SELECT CAST(0 AS BIGINT) AS varying")
def _(spark, d):
    rows = _weighted(spark, d).groupBy("o_orderpriority").agg(F.count_distinct("weight").alias("n"))
    return rows.agg(F.count_if(F.col("n") > 1).alias("varying"))


_WINDOWS = [(1993, 1995), (1994, 1997)]
_WM = f"WITH draws AS ({duck(DRAWS)}), win AS (SELECT * FROM (VALUES (1993, 1995, '1993-1995'), (1994, 1997, '1994-1997')) AS t(lo, hi, label)), means AS (SELECT c_nationkey, o_orderpriority, m, label AS \"window\", avg(value) AS value FROM draws JOIN win ON year BETWEEN lo AND hi GROUP BY ALL), models AS ({MODELS}), weighted AS (SELECT means.*, weight FROM means JOIN models ON lower(replace(replace(model, '*', ''), 'surrogate_', '')) = lower(o_orderpriority)) "


def _means(spark, d, check=False):
    return stats.window_means(sql(spark, d, DRAWS), time_col="year", windows=_WINDOWS, check=check)


def _weighted(spark, d, check=False):
    return regroup.attach_member_weights(_means(spark, d, check), spark.sql(MODELS), "o_orderpriority", "weight", check=check)


@query("window_means_multi", _WM + 'SELECT c_nationkey, o_orderpriority, m, "window", round(value, 4) AS value FROM means')
def _(spark, d):
    return rounded(_means(spark, d), "value", n=4)


_POOL = "SELECT c_nationkey, \"window\", 'mean' AS statistic, round({m}, 7) AS value FROM {t} GROUP BY ALL"


@query("pooled_mean_quantiles", _WM + _POOL.format(m="avg(value)", t="means") + "".join(f" UNION ALL SELECT c_nationkey, \"window\", 'q{q:02d}', round(quantile_cont(value, CAST({q / 100} AS DOUBLE)), 7) FROM means GROUP BY ALL" for q in (5, 50, 95)))
def _(spark, d):
    return rounded(stats.pooled_statistics(_means(spark, d), sample_dims=["o_orderpriority", "m"], quantiles=(0.05, 0.5, 0.95), check=False), "value", n=7)


@query("pooled_weighted_mean", _WM + _POOL.format(m="sum(value * weight) / sum(weight)", t="weighted"))
def _(spark, d):
    return rounded(stats.pooled_statistics(_weighted(spark, d), sample_dims=["o_orderpriority", "m"], weight_col="weight", check=False), "value", n=7)


_WQ = _WM + ", p AS (SELECT *, sum(weight) OVER (PARTITION BY c_nationkey, \"window\" ORDER BY value, o_orderpriority, m ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY c_nationkey, \"window\") AS share FROM weighted) SELECT c_nationkey, \"window\", 'q17' AS statistic, round(max(CASE WHEN share < 0.17 THEN value END), 4) AS value FROM p GROUP BY ALL UNION ALL SELECT c_nationkey, \"window\", 'q83', round(max(CASE WHEN share < 0.83 THEN value END), 4) FROM p GROUP BY ALL"


def _quantiles(spark, d, check):
    out = stats.pooled_statistics(_weighted(spark, d, check), sample_dims=["o_orderpriority", "m"], weight_col="weight", quantiles=(0.17, 0.83), include_mean=False, check=check)
    return rounded(out.withColumn("value", F.when(F.col("value") != float("-inf"), F.col("value"))), "value", n=4)


query("pooled_weighted_quantiles", _WQ)(lambda spark, d: _quantiles(spark, d, False))
query("pooled_guarded", _WQ)(lambda spark, d: _quantiles(spark, d, True))


@query("summarize_samples_end_to_end", f"WITH draws AS ({duck(DRAWS)}), means AS (SELECT c_nationkey, o_orderpriority, m, avg(value) AS value FROM draws WHERE year BETWEEN 1993 AND 1996 GROUP BY ALL) SELECT c_nationkey, 'mean' AS statistic, round(avg(value), 4) AS value FROM means GROUP BY ALL UNION ALL SELECT c_nationkey, 'q50', round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 4) FROM means GROUP BY ALL")
def _(spark, d):
    return rounded(stats.summarize_samples(sql(spark, d, DRAWS), sample_dims=["o_orderpriority", "m"], time_col="year", window=(1993, 1996), quantiles=(0.5,), check=False), "value", n=4)


@query("subtract_sibling", f"WITH d AS ({duck(DATA)}) SELECT l_suppkey, year, l_returnflag, round(value - den, 4) AS value FROM d")
def _(spark, d):
    data = sql(spark, d, DATA)
    return rounded(regroup.subtract(data.drop("den"), data.drop("value").withColumnRenamed("den", "value")), "value", n=4)


@query("model_weight_attach", _WM + 'SELECT c_nationkey, o_orderpriority, m, "window", round(value, 4) AS value, CAST(weight AS DOUBLE) AS weight FROM weighted')
def _(spark, d):
    return rounded(_weighted(spark, d), "value", n=4)


@query("regroup_sum", f"SELECT o_orderpriority, year, round(sum(value), 2) AS value FROM ({duck(DRAWS)}) GROUP BY ALL")
def _(spark, d):
    return rounded(regroup.regroup_sum(sql(spark, d, DRAWS), ["o_orderpriority", "year"]), "value", n=2)


@query("regroup_weighted_mean", f"SELECT year, l_returnflag, round(sum(value * den) / sum(den), 4) AS value FROM ({duck(DATA)}) GROUP BY ALL")
def _(spark, d):
    return rounded(regroup.regroup_mean(sql(spark, d, DATA), ["year", "l_returnflag"], "den"), "value", n=4)


@query("ratio_external_denominator", f"WITH a AS (SELECT year, c_nationkey, sum(value) AS v FROM ({duck(DRAWS)}) GROUP BY ALL), b AS (SELECT year, c_nationkey, sum(m) AS v FROM ({duck(DRAWS)}) GROUP BY ALL) SELECT year, c_nationkey, round(a.v / b.v, 7) AS value FROM a JOIN b USING (year, c_nationkey)")
def _(spark, d):
    rows = sql(spark, d, DRAWS)
    a = regroup.regroup_sum(rows, ["year", "c_nationkey"])
    b = regroup.regroup_sum(rows.withColumn("value", F.col("m")), ["year", "c_nationkey"])
    return rounded(regroup.ratio_of(a, b, ["year", "c_nationkey"]), "value", n=7)


@query("ratio_of_window_means", f"SELECT l_suppkey, round(avg(value) / avg(den), 4) AS value FROM ({duck(DATA)}) GROUP BY ALL")
def _(spark, d):
    return rounded(regroup.ratio_of_means(sql(spark, d, DATA), ["l_suppkey"], "value", "den"), "value", n=4)


@query("percent_recentred", f"WITH d AS (SELECT l_suppkey, year, l_returnflag, exp(den / 10000) * exp(CAST(0.04 AS DOUBLE)) - 1 AS x FROM ({duck(DATA)})) SELECT l_suppkey, year, l_returnflag, round(100 * (x - avg(CASE WHEN year BETWEEN 1993 AND 1995 THEN x END) OVER (PARTITION BY l_suppkey, l_returnflag)), 6) AS value FROM d")
def _(spark, d):
    data = sql(spark, d, DATA).select("l_suppkey", "year", "l_returnflag", (F.col("den") / 10000).alias("value"))
    return rounded(regroup.percent_change(data, series=["l_suppkey", "l_returnflag"], time_col="year", base=(1993, 1995), residual_variance=0.08), "value")


@query("crop_weight_build", f"WITH w AS ({duck(OVERLAP)}), r AS (SELECT n_regionkey, c_nationkey, l_suppkey, s_acctbal * area_raw / sum(area_raw) OVER (PARTITION BY l_suppkey) AS raw FROM w JOIN supplier ON s_suppkey = l_suppkey) SELECT n_regionkey, c_nationkey, l_suppkey, round(raw, 6) AS raw, round(raw / nullif(sum(raw) OVER (PARTITION BY n_regionkey, c_nationkey), 0), 6) AS wt FROM r")
def _(spark, d):
    areas = sql(spark, d, "SELECT s_suppkey AS l_suppkey, s_acctbal AS amount FROM {supplier}")
    out = regroup.split_area_weights(sql(spark, d, OVERLAP), areas, source=["l_suppkey"], target=IDS)
    return rounded(out.select(*IDS, "l_suppkey", "raw", "wt"), "raw", "wt")


@query("legacy_export", f"WITH w AS ({duck(OVERLAP)}) SELECT CAST(l_suppkey AS VARCHAR) AS hierid, CAST(n_regionkey AS DOUBLE) AS pix_cent_x, CAST(c_nationkey AS DOUBLE) AS pix_cent_y, area_raw AS area, pop_raw AS pop, sum(area_raw) OVER (PARTITION BY l_suppkey) AS areatotal, sum(pop_raw) OVER (PARTITION BY l_suppkey) AS poptotal, round(area_raw / 10, 6) AS areawt, round(pop_raw / 10, 6) AS popwt, CAST(dense_rank() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS BIGINT) AS shpid FROM w")
def _(spark, d):
    frame = sql(spark, d, OVERLAP).selectExpr("l_suppkey AS hierid", "cast(n_regionkey AS double) AS cell_lon", "cast(c_nationkey AS double) AS cell_lat", "area_raw", "pop_raw", "round(area_raw / 10, 6) AS areawt", "round(pop_raw / 10, 6) AS popwt")
    return compare.legacy_export(frame, names=("area", "pop"))


@query("merge_weight_sets", _W["per_source"] + "SELECT n_regionkey, c_nationkey, l_suppkey, round(areawt, 9) AS areawt, area_raw, 'native' AS area_method, CASE WHEN s_acctbal > 4000 THEN 'supplement' ELSE 'canonical' END AS source FROM w JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, d):
    a = weights(spark, d, strict=True)
    rich = sql(spark, d, "SELECT s_suppkey AS l_suppkey FROM {supplier} WHERE s_acctbal > 4000")
    return rounded(compare.merge_weights(a.frame.join(rich, "l_suppkey", "left_anti"), a.frame.join(rich, "l_suppkey", "left_semi"), a.schema, id_col="l_suppkey"), "areawt", n=9)


def _two(spark, d):
    """Area weights of the larger overlaps, and population weights where there is a population."""
    names = [F.col("l_suppkey").alias("hierid"), F.col("n_regionkey").alias("cell_ix"), F.col("c_nationkey").alias("cell_iy")]
    left = weights(spark, d).frame.where("area_raw >= 20").select(*names, "areawt")
    right = fallback(spark, d, "nan").where("popwt > 0").select(*names, F.col("popwt").alias("areawt"))
    return left, right


_TWO = _W["per_source"] + ", l AS (SELECT l_suppkey AS hierid, n_regionkey AS ix, c_nationkey AS iy, areawt AS a FROM w WHERE area_raw >= 20), r AS (SELECT l_suppkey AS hierid, n_regionkey AS ix, c_nationkey AS iy, pop_raw / t AS b FROM (SELECT *, sum(pop_raw) OVER (PARTITION BY l_suppkey) AS t FROM w) WHERE pop_raw > 0), both_ AS (SELECT coalesce(l.hierid, r.hierid) AS hierid, a, b FROM l FULL JOIN r ON l.hierid = r.hierid AND l.ix = r.ix AND l.iy = r.iy), f AS (SELECT hierid, CASE WHEN count(a) > 0 AND count(b) > 0 THEN 'both' WHEN count(a) > 0 THEN 'left_only' ELSE 'right_only' END AS presence, max(abs(coalesce(a, 0) - coalesce(b, 0))) AS d FROM both_ GROUP BY 1) "


@query("compare_outputs_report", _TWO + "SELECT CAST(count_if(presence = 'both') AS BIGINT) AS \"both\", CAST(count_if(presence = 'left_only') AS BIGINT) AS left_only, CAST(count_if(presence = 'right_only') AS BIGINT) AS right_only, round(quantile_cont(CASE WHEN presence = 'both' THEN d END, CAST(0.5 AS DOUBLE)), 6) AS median_diff, round(quantile_cont(CASE WHEN presence = 'both' THEN d END, CAST(0.95 AS DOUBLE)), 6) AS p95_diff, round(max(CASE WHEN presence = 'both' THEN d END), 6) AS largest_diff, CAST(count_if(presence = 'both' AND d > 0.001) AS BIGINT) AS above FROM f")
def _(spark, d):
    left, right = _two(spark, d)
    return rounded(compare.comparison_report(compare.differences(left, right, region="hierid", cell=["cell_ix", "cell_iy"], weight="area")), "median_diff", "p95_diff", "largest_diff")


@query("max_cell_displacement", _TWO + ", ml AS (SELECT hierid, ix, iy, row_number() OVER (PARTITION BY hierid ORDER BY a DESC, ix, iy) AS n FROM l), mr AS (SELECT hierid, ix, iy, row_number() OVER (PARTITION BY hierid ORDER BY b DESC, ix, iy) AS n FROM r) SELECT ml.hierid, ml.ix <> mr.ix OR ml.iy <> mr.iy AS displaced FROM ml JOIN mr USING (hierid) WHERE ml.n = 1 AND mr.n = 1")
def _(spark, d):
    left, right = _two(spark, d)
    return compare.displaced(left, right, region="hierid", cell=["cell_ix", "cell_iy"], weight="area")


@query("keep_drop_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14) AND p_brand NOT IN ('Brand#11', 'Brand#22')")
def _(spark, d):
    return compare.keep_drop(sql(spark, d, "SELECT p_partkey, p_brand, p_size FROM {part}"), {"p_size": [1, 5, 9, 14]}, {"p_brand": ["Brand#11", "Brand#22"]})


@query("id_like_search", "SELECT DISTINCT c_name FROM customer WHERE c_name LIKE '%1_3%' ORDER BY c_name LIMIT 20")
def _(spark, d):
    return compare.find_ids(sql(spark, d, "SELECT c_name FROM {customer}"), "c_name", "%1_3%", 20)


@query("top_deviations", _TWO + "SELECT hierid, round(d, 6) AS max_diff FROM f ORDER BY d DESC, hierid LIMIT 10")
def _(spark, d):
    left, right = _two(spark, d)
    found = compare.differences(left, right, region="hierid", cell=["cell_ix", "cell_iy"], weight="area").select("hierid", "max_diff")
    return rounded(compare.top_by(found, "max_diff", 10, ["hierid"]), "max_diff")


_BIN = f"WITH p AS ({duck(POINTS)}), c AS (SELECT CAST(((CAST(floor(lon + 180) AS BIGINT) % 360) + 360) % 360 AS BIGINT) AS cell_ix, CAST(least(179, greatest(0, floor(lat + 90))) AS BIGINT) AS cell_iy, sum(value) AS raw FROM p GROUP BY 1, 2) "
_SEG = f"b AS ({duck(BOXES)}), s AS (SELECT n_nationkey, x0, y0, x1, y1, ix AS cell_ix, iy AS cell_iy, greatest(0, least(x1, ix - 179) - greatest(x0, ix - 180)) * greatest(0, least(y1, iy - 89) - greatest(y0, iy - 90)) AS planar_area FROM b, range(0, 360) AS gx(ix), range(0, 180) AS gy(iy) WHERE ix - 180 < x1 AND ix - 179 > x0 AND iy - 90 < y1 AND iy - 89 > y0) "


@query("grid_point_binning", _BIN + "SELECT cell_ix, cell_iy, round(raw, 4) AS raw FROM c")
def _(spark, d):
    return rounded(gr.binned(sql(spark, d, POINTS), GRID), "raw", n=4)


@query("grid_invariants", "SELECT * FROM (VALUES ('ix', CAST(1 AS BIGINT)), ('iy', CAST(0 AS BIGINT)), ('lon', CAST(1 AS BIGINT)), ('lat', CAST(0 AS BIGINT)), ('duplicate', CAST(0 AS BIGINT))) AS t(problem, n)")
def _(spark, d):
    cells = sql(spark, d, "SELECT n_nationkey, CAST(n_nationkey * 15.625 AS BIGINT) AS cell_ix, CAST(n_nationkey AS BIGINT) AS cell_iy FROM {nation}").withColumn("cell_lon", GRID.lon(F.col("cell_ix"))).withColumn("cell_lat", GRID.lat(F.col("cell_iy")))
    return validate.grid_problems(cells, GRID.n_ix, GRID.n_iy, ["n_nationkey"])


@query("box_cell_segments", "WITH " + _SEG + "SELECT n_nationkey, cell_ix, cell_iy, CAST(cell_ix + 0.5 - 180.0 AS DOUBLE) AS cell_lon, CAST(cell_iy + 0.5 - 90.0 AS DOUBLE) AS cell_lat, round(planar_area, 6) AS fraction, round(planar_area, 6) AS planar_area FROM s")
def _(spark, d):
    return rounded(gr.box_cells(sql(spark, d, BOXES), GRID, ["n_nationkey"]), "fraction", "planar_area")


@query("box_zonal_exact", _BIN + ", " + _SEG + "SELECT n_nationkey, round(coalesce(sum(raw * planar_area), 0), 4) AS raw FROM s LEFT JOIN c USING (cell_ix, cell_iy) GROUP BY 1")
def _(spark, d):
    return rounded(gr.zonal_exact(gr.box_cells(sql(spark, d, BOXES), GRID, ["n_nationkey"]), gr.binned(sql(spark, d, POINTS), GRID), ["n_nationkey"]), "raw", n=4)


@query("box_zonal_centroid", f"WITH p AS ({duck(POINTS)}), b AS ({duck(BOXES)}) SELECT n_nationkey, round(coalesce(sum(value), 0), 4) AS raw FROM b LEFT JOIN p ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY 1")
def _(spark, d):
    return rounded(gr.zonal_centroid(sql(spark, d, BOXES), sql(spark, d, POINTS), GRID, ["n_nationkey"]), "raw", n=4)


@query("nearest_cell_rows", f"WITH b AS ({duck(BOXES)}) SELECT n_nationkey, CAST(floor((x0 + x1) / 2 + 180) AS BIGINT) AS cell_ix, CAST(floor((y0 + y1) / 2 + 90) AS BIGINT) AS cell_iy, floor((x0 + x1) / 2 + 180) + 0.5 - 180 AS cell_lon, floor((y0 + y1) / 2 + 90) + 0.5 - 90 AS cell_lat, CAST(1 AS DOUBLE) AS popwt, CAST(0 AS DOUBLE) AS pop_raw, 'nearest_cell' AS pop_method FROM b WHERE y0 < 0")
def _(spark, d):
    boxes = sql(spark, d, BOXES)
    return gr.nearest_cell_rows(boxes.selectExpr("n_nationkey", "(x0 + x1) / 2 AS lon", "(y0 + y1) / 2 AS lat"), boxes.where("y0 >= 0"), GRID, ["n_nationkey"], ["pop"])


_GRAD = "WITH g AS (SELECT vec_id, label, unnest(embedding) AS g, unnest(range(len(embedding))) AS i FROM embeddings), a AS (SELECT label, i, sum((1 + vec_id % 3) * CAST(g AS DOUBLE)) / sum(1 + vec_id % 3) AS v FROM g GROUP BY 1, 2) "


@query("gradient_aggregate", _GRAD + "SELECT label, CAST(i AS INT) AS i, round(v, 6) AS v FROM a")
def _(spark, d):
    return rounded(_gradient(spark, d).select("label", F.posexplode("gradient").alias("i", "v")), "v")


def _gradient(spark, d):
    """Gradients of all components, with a weight of 1, 2 or 3 for each vector."""
    e = sql(spark, d, "SELECT vec_id, label, embedding AS gradient FROM {embeddings}")
    w = e.select("label", "vec_id", (1 + F.col("vec_id") % 3).alias("gwt"))
    return gradients.aggregate_gradient(w, e.select("vec_id", "gradient"), ids=["label"], keys=["vec_id"], weight="g", normalize=True)


def band(n: int) -> list[list[float]]:
    """A covariance with 0.5 on the diagonal and 0.1 beside it."""
    return [[0.5 if i == j else 0.1 if abs(i - j) == 1 else 0.0 for j in range(n)] for i in range(n)]


@query("delta_method_sd", _GRAD + ", b AS (SELECT label, i, v, coalesce(lead(v) OVER (PARTITION BY label ORDER BY i), 0) AS u FROM a) SELECT label, round(sqrt(sum(0.5::DOUBLE * v * v + 0.2::DOUBLE * v * u)), 6) AS sd, round(sum(CASE WHEN i % 2 = 0 THEN v ELSE -v END), 6) AS mean FROM b GROUP BY 1")
def _(spark, d):
    g = _gradient(spark, d)
    n = g.select(F.max(F.size("gradient"))).first()[0]
    return rounded(gradients.delta_method(g, band(n), [1.0 if i % 2 == 0 else -1.0 for i in range(n)]).select("label", "sd", "mean"), "sd", "mean")


@query("best_target_per_source", _W["per_source"] + "SELECT l_suppkey, n_regionkey, c_nationkey, round(areawt, 9) AS areawt FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY areawt DESC, n_regionkey, c_nationkey) AS n FROM w) WHERE n = 1")
def _(spark, d):
    return rounded(regroup.best_target(weights(spark, d).frame, ["l_suppkey"], IDS, "areawt"), "areawt", n=9)


@query("min_segment_accounting", f"WITH w AS ({duck(OVERLAP)}) SELECT l_suppkey, CAST(count_if(area_raw < 20) AS BIGINT) AS dropped, round(sum(CASE WHEN area_raw < 20 THEN area_raw ELSE 0 END) / sum(area_raw), 6) AS discarded_share, count_if(area_raw >= 20) = 0 AS gone FROM w GROUP BY 1 HAVING count_if(area_raw < 20) > 0")
def _(spark, d):
    return rounded(gr.large_segments(sql(spark, d, OVERLAP), ["l_suppkey"], 20.0)[1], "discarded_share")


@query("every_year_series", f"WITH s AS (SELECT l_suppkey, CAST(year - year % 5 AS INT) AS y0, sum(den) AS v FROM ({duck(DATA)}) GROUP BY 1, 2) SELECT l_suppkey, CAST(y AS INT) AS year, round(v, 4) AS v FROM s JOIN (SELECT unnest(range(1990, 2000)) AS y) ON y - y % 5 = y0")
def _(spark, d):
    steps = sql(spark, d, DATA).groupBy("l_suppkey", (F.col("year") - F.col("year") % 5).alias("year")).agg(F.round(F.sum("den"), 4).alias("v"))
    return regroup.every_year(steps, (1990, 1999))


# Polygons: boxes as WKB on grids, pixels and other polygons. Areas are those of boxes with geodesic upper and lower edges.
TILES = """SELECT a.n_nationkey * 25 + b.n_nationkey AS tile, a.n_nationkey * CAST(14.4 AS DOUBLE) - 180 AS x0, b.n_nationkey * CAST(7.2 AS DOUBLE) - 90 AS y0, a.n_nationkey * CAST(14.4 AS DOUBLE) - CAST(165.6 AS DOUBLE) AS x1, b.n_nationkey * CAST(7.2 AS DOUBLE) - CAST(82.8 AS DOUBLE) AS y1 FROM {nation} a CROSS JOIN {nation} b"""
_E2 = "(0.0066943799901413165::DOUBLE)"


def _q(lat: str) -> str:
    s, e = f"sin(radians({lat}))", f"sqrt({_E2})"
    return f"((1 - {_E2}) * ({s} / (1 - {_E2} * {s} * {s}) + atanh({e} * {s}) / {e}))"


def area_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    """Square metres of a box, as the difference of what lies below its upper and its lower edge."""
    half = lambda y: f"tan(asin(greatest(-1, least(1, {_q(y)} / {_q('90')}))) / 2)"
    under = lambda y: f"atan2(tan(radians({x1} - {x0}) / 2) * 2 * {half(y)}, 1 + {half(y)} * {half(y)})"
    return f"abs({under(y1)} - {under(y0)}) * 6378137.0::DOUBLE * 6378137.0::DOUBLE * {_q('90')}"


_CELLS = "WITH " + _SEG + f", piece AS (SELECT n_nationkey, cell_ix, cell_iy, planar_area, {area_sql('greatest(x0, cell_ix - 180.0)', 'greatest(y0, cell_iy - 90.0)', 'least(x1, cell_ix - 179.0)', 'least(y1, cell_iy - 89.0)')} AS area_raw FROM s)"


def _polygons(spark, d, text=BOXES, ids=("n_nationkey",)):
    return polygons.boxes(sql(spark, d, text), list(ids))


@query("polygon_cells", _CELLS + " SELECT n_nationkey, cell_ix, cell_iy, round(planar_area, 6) AS fraction, round(area_raw / 1e6, 3) AS km2, planar_area = 1 AS is_interior FROM piece")
def _(spark, d):
    out = polygons.cells(_polygons(spark, d), ["n_nationkey"], GRID)
    return rounded(rounded(out.withColumn("km2", F.col("area_raw") / 1e6).drop("area_raw"), "fraction"), "km2", n=3)


@query("polygon_areas", f"SELECT n_nationkey, round((x1 - x0) * (y1 - y0), 6) AS planar, round({area_sql('x0', 'y0', 'x1', 'y1')} / 1e6, 3) AS km2 FROM ({duck(BOXES)})")
def _(spark, d):
    out = polygons.described(_polygons(spark, d)).selectExpr("n_nationkey", "planar_area AS planar", "geodesic_area / 1e6 AS km2")
    return rounded(rounded(out, "planar"), "km2", n=3)


_TILED = f"WITH b AS ({duck(BOXES)}), t AS ({duck(TILES)}), o AS (SELECT n_nationkey, tile, greatest(b.x0, t.x0) AS x0, greatest(b.y0, t.y0) AS y0, least(b.x1, t.x1) AS x1, least(b.y1, t.y1) AS y1 FROM b JOIN t ON b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1), p AS (SELECT n_nationkey, tile, {area_sql('x0', 'y0', 'x1', 'y1')} AS area_raw FROM o)"


@query("polygon_overlay", _TILED + " SELECT n_nationkey, tile, round(area_raw / 1e6, 3) AS km2 FROM p")
def _(spark, d):
    out = polygons.overlay(_polygons(spark, d), ["n_nationkey"], _polygons(spark, d, TILES, ["tile"]), ["tile"], bin_degrees=8.0)
    return rounded(out.withColumn("km2", F.col("area_raw") / 1e6).drop("area_raw"), "km2", n=3)


@query("polygon_coverage_ratio", _TILED + f", u AS (SELECT tile, {area_sql('x0', 'y0', 'x1', 'y1')} AS area FROM t), c AS (SELECT tile, sum(area_raw) AS s FROM p GROUP BY 1) SELECT tile, round(coalesce(s, 0) / area, 6) AS share FROM u LEFT JOIN c USING (tile) WHERE coalesce(s, 0) / area < 0.999")
def _(spark, d):
    tiles = _polygons(spark, d, TILES, ["tile"])
    parts = polygons.overlay(_polygons(spark, d), ["n_nationkey"], tiles, ["tile"], bin_degrees=8.0)
    return rounded(gr.covered_share(parts, polygons.described(tiles).selectExpr("tile", "geodesic_area AS area"), ["tile"]), "share")


@query("points_in_polygons", f"WITH p AS ({duck(POINTS)}), b AS ({duck(BOXES)}) SELECT n_nationkey, lon, lat, value FROM p JOIN b ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def _(spark, d):
    return polygons.points_in(sql(spark, d, POINTS), _polygons(spark, d), ["n_nationkey"])


def _pixels(spark, d):
    return zonal.pixels(sql(spark, d, POINTS), GRID)


@query("polygon_zonal_exact", _BIN + ", " + _SEG + "SELECT n_nationkey, round(coalesce(sum(raw * planar_area), 0), 4) AS raw FROM s LEFT JOIN c USING (cell_ix, cell_iy) GROUP BY 1")
def _(spark, d):
    return rounded(zonal.zonal_sums(_polygons(spark, d), ["n_nationkey"], _pixels(spark, d), GRID), "raw", n=4)


@query("polygon_zonal_centroid", _BIN + f", b AS ({duck(BOXES)}) SELECT n_nationkey, round(coalesce(sum(raw), 0), 4) AS raw FROM b LEFT JOIN c ON cell_ix - 179.5 > x0 AND cell_ix - 179.5 < x1 AND cell_iy - 89.5 > y0 AND cell_iy - 89.5 < y1 GROUP BY 1")
def _(spark, d):
    return rounded(zonal.zonal_sums(_polygons(spark, d), ["n_nationkey"], _pixels(spark, d), GRID, coverage="pixel_centroid"), "raw", n=4)


@query("polygon_zonal_area_weighted", _BIN + ", " + _SEG + f"SELECT n_nationkey, round(coalesce(sum(raw * planar_area * {area_sql('0', 'cell_iy - 90.0', '1', 'cell_iy - 89.0')}), 0) / 1e9, 3) AS raw FROM s LEFT JOIN c USING (cell_ix, cell_iy) GROUP BY 1")
def _(spark, d):
    out = zonal.zonal_sums(_polygons(spark, d), ["n_nationkey"], _pixels(spark, d), GRID, kind="area_weighted_sum")
    return rounded(out.withColumn("raw", F.col("raw") / 1e9), "raw", n=3)


@query("grid_weight_generation", _BIN.replace("WITH p", _CELLS + ", p") + ", r AS (SELECT n_nationkey, cell_ix, cell_iy, area_raw, coalesce(CASE WHEN raw > 0 THEN raw END * planar_area, 0) AS pop FROM piece LEFT JOIN c USING (cell_ix, cell_iy)), t AS (SELECT *, sum(pop) OVER (PARTITION BY n_nationkey) AS tp, sum(area_raw) OVER (PARTITION BY n_nationkey) AS ta FROM r) SELECT n_nationkey, cell_ix, cell_iy, round(area_raw / ta, 7) AS areawt, round(CASE WHEN tp > 0 THEN pop / tp ELSE area_raw / ta END, 7) AS popwt, round(pop, 4) AS pop_raw, CASE WHEN tp > 0 THEN 'native' ELSE 'area_fallback' END AS pop_method FROM t")
def _(spark, d):
    people = _pixels(spark, d).where("value > 0")
    a = generate.weights_on_grid(_polygons(spark, d), ["n_nationkey"], GRID, [generate.Weight("area"), generate.Weight("pop", people, GRID, fallback="area")])
    return rounded(rounded(a.frame.select("n_nationkey", *generate.CELL, "areawt", "popwt", "pop_raw", "pop_method"), "areawt", "popwt", n=7), "pop_raw", n=4)


@query("polygon_weight_generation", _TILED + " SELECT n_nationkey, tile, round(area_raw / sum(area_raw) OVER (PARTITION BY tile), 7) AS areawt, 'native' AS area_method FROM p")
def _(spark, d):
    a = generate.weights_on_polygons(_polygons(spark, d), ["n_nationkey"], _polygons(spark, d, TILES, ["tile"]), ["tile"], [generate.Weight("area")], normalization="per_source", regions_version="boxes-1", source_version="tiles-1", on_zero_overlap="skip", bin_degrees=8.0)
    return rounded(a.frame.select("n_nationkey", "tile", "areawt", "area_method"), "areawt", n=7)


@query("polygon_dissolve", f"WITH t AS ({duck(TILES)}) SELECT CAST(floor((x0 + 180) / 72) AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS pieces, round(sum((x1 - x0) * (y1 - y0)), 4) AS union_area FROM t GROUP BY 1")
def _(spark, d):
    tiles = sql(spark, d, TILES).withColumn("block", F.floor((F.col("x0") + 180) / 72))
    out = polygons.dissolved(polygons.boxes(tiles, ["block"]), ["block"])
    return rounded(out.select("block", "pieces", "union_area"), "union_area", n=4)


@query("legacy_comparison_report", _TWO + ", j AS (SELECT coalesce(l.hierid, r.hierid) AS hierid, coalesce(l.ix, r.ix) AS ix, coalesce(l.iy, r.iy) AS iy, a, b FROM l FULL JOIN r ON l.hierid = r.hierid AND l.ix = r.ix AND l.iy = r.iy), g AS (SELECT hierid, count(a) AS na, count(b) AS nb, max(abs(coalesce(a, 0) - coalesce(b, 0))) AS d FROM j GROUP BY 1), pa AS (SELECT hierid, ix, iy FROM (SELECT *, row_number() OVER (PARTITION BY hierid ORDER BY a DESC, ix, iy) AS n FROM j WHERE a IS NOT NULL) WHERE n = 1), pb AS (SELECT hierid, ix, iy FROM (SELECT *, row_number() OVER (PARTITION BY hierid ORDER BY b DESC, ix, iy) AS n FROM j WHERE b IS NOT NULL) WHERE n = 1), m AS (SELECT g.*, CASE WHEN na > 0 AND nb > 0 THEN d END AS e, pa.ix <> pb.ix OR pa.iy <> pb.iy AS moved FROM g LEFT JOIN pa USING (hierid) LEFT JOIN pb USING (hierid)) SELECT CAST(count(*) AS BIGINT) AS regions, CAST(count_if(na > 0 AND nb > 0) AS BIGINT) AS both_native, CAST(count_if(na = 0 AND nb = 0) AS BIGINT) AS both_missing, CAST(count_if(na = 0 AND nb > 0) AS BIGINT) AS ours_missing, CAST(count_if(na > 0 AND nb = 0) AS BIGINT) AS legacy_missing, round(quantile_cont(e, CAST(0.5 AS DOUBLE)), 6) AS delta_median, round(quantile_cont(e, CAST(0.95 AS DOUBLE)), 6) AS delta_p95, round(max(e), 6) AS delta_max, CAST(count_if(e IS NOT NULL AND moved) AS BIGINT) AS displaced FROM m")
def _(spark, d):
    side = lambda df: df.select(F.col("hierid").cast("string").alias("hierid"), F.col("cell_ix").cast("double").alias("pix_cent_x"), F.col("cell_iy").cast("double").alias("pix_cent_y"), F.col("areawt").alias("cropwt"))
    report, _regions = compare.legacy_comparison(*map(side, _two(spark, d)))
    return rounded(report, "delta_median", "delta_p95", "delta_max")


@query("requested_ids", "SELECT n_nationkey, CASE WHEN s_suppkey IS NULL THEN 'unknown' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey WHERE s_suppkey IS NULL")
def _(spark, d):
    known = sql(spark, d, "SELECT s_nationkey AS n_nationkey, s_name AS geometry FROM {supplier} WHERE s_acctbal > 5000")
    return compare.reconciled(sql(spark, d, "SELECT n_nationkey FROM {nation}"), known, ["n_nationkey"])


@query("uniform_resolution", "SELECT CAST(14.4 AS DOUBLE) AS x, CAST(7.2 AS DOUBLE) AS y")
def _(spark, d):
    tiles = sql(spark, d, TILES)
    return spark.createDataFrame([tuple(round(gr.uniform_resolution(tiles, c, 1e-6), 6) for c in ("x0", "y0"))], "x double, y double")


@query("implied_factor", f"WITH d AS ({duck(DATA)}) SELECT l_suppkey, year, CAST(2.5 AS DOUBLE) AS factor FROM d WHERE abs(den) > 1e-9 GROUP BY 1, 2")
def _(spark, d):
    pairs = sql(spark, d, DATA).select("l_suppkey", "year", "den", (F.col("den") * 2.5).alias("worth"))
    return rounded(products.implied_factor(pairs, ["l_suppkey"], over="worth", under="den"), "factor")


@query("inhabited_targets", f"WITH w AS ({duck(OVERLAP)}) SELECT n_regionkey, c_nationkey, l_suppkey, pop_raw FROM w WHERE l_suppkey IN (SELECT l_suppkey FROM w GROUP BY 1 HAVING min(pop_raw) > 0)")
def _(spark, d):
    rows = sql(spark, d, OVERLAP).select(*IDS, "l_suppkey", "pop_raw")
    return products.inhabited(rows, rows, ["l_suppkey"], pop="pop_raw")[1]


@query("border_share", f"SELECT round(sum(value), 2) AS total, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN value ELSE 0 END), 2) AS at_home, round(1 - sum(CASE WHEN o_orderpriority = '1-URGENT' THEN value ELSE 0 END) / sum(value), 8) AS elsewhere FROM ({duck(DRAWS)})")
def _(spark, d):
    return rounded(rounded(products.border_share(sql(spark, d, DRAWS), "o_orderpriority", "1-URGENT"), "total", "at_home", n=2), "elsewhere", n=8)


@query("widest_split", f"WITH w AS ({duck(OVERLAP)}) SELECT l_suppkey, CAST(count(DISTINCT (n_regionkey, c_nationkey)) AS BIGINT) AS targets FROM w GROUP BY 1 ORDER BY targets DESC, l_suppkey LIMIT 1")
def _(spark, d):
    return products.widest(sql(spark, d, OVERLAP), ["l_suppkey"], IDS)


@query("target_crosswalk", f"WITH a AS (SELECT c_nationkey, year, sum(value) AS v FROM ({duck(DRAWS)}) GROUP BY 1, 2), l AS (SELECT c_nationkey, v FROM a WHERE year = 1994), r AS (SELECT c_nationkey AS other, v FROM a WHERE year = 1996) SELECT c_nationkey, other, round(l.v, 2) AS v_left, round(r.v, 2) AS v_right, round(r.v - l.v, 2) AS difference FROM (SELECT c_nationkey, c_nationkey AS other FROM (SELECT DISTINCT c_nationkey FROM customer)) JOIN l USING (c_nationkey) JOIN r USING (other)")
def _(spark, d):
    a = sql(spark, d, DRAWS).groupBy("c_nationkey", "year").agg(F.sum("value").alias("v"))
    pairs = sql(spark, d, "SELECT DISTINCT c_nationkey, c_nationkey AS other FROM {customer}")
    out = products.crosswalk(pairs, a.where("year = 1994"), a.where("year = 1996").withColumnRenamed("c_nationkey", "other"), ["c_nationkey"], ["other"], "v")
    return rounded(out, "v_left", "v_right", "difference", n=2)


@query("valued_measures", f"SELECT l_suppkey, year, l_returnflag, round(den * value, 2) AS den_pop, round(den * 0.5, 4) AS value, round(0.5 / 0.00487, 6) AS gdp FROM ({duck(DATA)})")
def _(spark, d):
    rows = sql(spark, d, DATA).withColumnRenamed("value", "people").withColumn("factor", F.lit(0.5))
    out = products.valued(rows, effect="den", population="people", factor="factor").drop("people", "factor", "den")
    return rounded(rounded(rounded(out, "den_pop", n=2), "value", n=4), "gdp")


@query("wide_and_long", f"SELECT l_suppkey, year, l_returnflag, round(value, 2) AS value FROM ({duck(DATA)})")
def _(spark, d):
    rows = rounded(sql(spark, d, DATA).drop("den"), "value", n=2)
    wide = products.wide(rows, ["l_suppkey", "year"], "l_returnflag", values=["A", "N", "R"])
    return netcdf.melted(wide, ["l_suppkey", "year"], ["A", "N", "R"], "l_returnflag")


@query("declared_members", f"WITH models AS ({MODELS}) SELECT c_nationkey, o_orderpriority, m, year, round(value, 2) AS value FROM ({duck(DRAWS)}) WHERE lower(o_orderpriority) IN (SELECT lower(replace(replace(model, '*', ''), 'surrogate_', '')) FROM models WHERE weight > 0.15)")
def _(spark, d):
    return rounded(products.members(sql(spark, d, DRAWS), spark.sql(MODELS).where("weight > 0.15"), "o_orderpriority"), "value", n=2)


@query("display_names", "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return products.named(sql(spark, d, "SELECT c_custkey, c_nationkey FROM {customer}"), sql(spark, d, "SELECT n_nationkey AS c_nationkey, n_name FROM {nation}"), ["c_nationkey"])


@query("parent_codes", "SELECT n_nationkey, concat('N.', n_regionkey, '_1') AS parent FROM nation")
def _(spark, d):
    return sql(spark, d, "SELECT n_nationkey, concat('N.', n_regionkey, '.', n_nationkey, '_1') AS code FROM {nation}").select("n_nationkey", products.parent_code("code").alias("parent"))


@query("presented_units", f"SELECT l_suppkey, year, l_returnflag, round(value * 1e-9, 9) AS billions, round(den / 0.0036, 4) AS dollars FROM ({duck(DATA)})")
def _(spark, d):
    out = sql(spark, d, DATA).select("l_suppkey", "year", "l_returnflag", products.scaled("value", "billions").alias("billions"), products.scaled("den", "energy_dollars").alias("dollars"))
    return rounded(rounded(out, "billions", n=9), "dollars", n=4)


@query("canonical_order", _W["per_source"] + "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, round(areawt, 9) AS areawt, area_raw, 'native' AS area_method FROM w")
def _(spark, d):
    a = weights(spark, d)
    out = compare.canonical(a.frame, a.schema)
    return rounded(out.select(*(F.col(c).cast("string").alias(c) for c in (*IDS, "l_suppkey")), "areawt", "area_raw", "area_method"), "areawt", n=9)


@query("pooled_whole_table", f"SELECT 'mean' AS statistic, round(avg(value), 4) AS value FROM ({duck(DRAWS)})" + "".join(f" UNION ALL SELECT 'q{q:02d}', round(quantile_cont(value, CAST({q / 100} AS DOUBLE)), 4) FROM ({duck(DRAWS)})" for q in (5, 50, 95)))
def _(spark, d):
    draws = sql(spark, d, DRAWS)
    return rounded(stats.pooled_statistics(draws, sample_dims=["c_nationkey", "o_orderpriority", "m", "year"], quantiles=(0.05, 0.5, 0.95)), "value", n=4)


@query("polygon_problems", "SELECT * FROM (VALUES ('null_key', CAST(0 AS BIGINT)), ('duplicate', CAST(0 AS BIGINT)), ('unknown_source', CAST(0 AS BIGINT))) AS t(problem, n) UNION ALL SELECT 'missing_source', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
def _(spark, d):
    a = weights(spark, d)
    return validate.polygon_problems(a.frame, a.schema, sql(spark, d, "SELECT s_suppkey AS l_suppkey FROM {supplier}"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _REG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _REG.items() if o is not None}
