"""Hand-computed cases of application, statistics, normalisation, gradients and the tree."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import compare, gradients, normalize, products, regroup, stats, validate
from tessella.operators.apply import apply_weights
from tessella.operators.grid import GridSpec, box_cells, covered_share, nearest_cell_rows, uniform_resolution
from tessella.plans import montecarlo
from tessella.plans.schema import OutputSchema, SourceUnits, WeightsArtifact
from tessella.sources.artifacts import load_artifact, write_artifact

UNIT = SourceUnits(("unit_id",))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def artifact(spark, weights, norm, ids=("adm0",)):
    names = [*ids, "unit_id", "popwt"]
    df = spark.createDataFrame(weights, ", ".join(f"{n} string" for n in names[:-1]) + ", popwt double")
    return WeightsArtifact(df, OutputSchema(ids, ("pop",), UNIT, norm), "targets-v1", "units-v1")


@pytest.fixture
def nested(spark):
    w = [("FJ", "north", "k1", 1.0), ("FJ", "north", "k2", 0.4), ("FJ", "south", "k2", 0.6), ("FJ", "south", "k3", 1.0), ("TO", "only", "k4", 1.0)]
    return artifact(spark, w, "per_source", ("adm0", "code"))


def test_extensive_splits_and_keeps_dimensions(spark, nested):
    amounts = {("k1", "dry"): 7.0, ("k2", "dry"): 50.0, ("k2", "wet"): 20.0, ("k3", "dry"): 1.0, ("k3", "wet"): 2.5, ("k4", "wet"): 9.0, ("k1", "wet"): 0.0, ("k4", "dry"): 4.0}
    data = spark.createDataFrame([(*k, v) for k, v in amounts.items()], "unit_id string, season string, value double")
    got = apply_weights(nested, data, kind="extensive", weight="pop", data_version="units-v1", group_col="season")
    assert rows(got.frame, "adm0", "code", "season", "value") == [("FJ", "north", "dry", 27.0), ("FJ", "north", "wet", 8.0), ("FJ", "south", "dry", 31.0), ("FJ", "south", "wet", 14.5), ("TO", "only", "dry", 4.0), ("TO", "only", "wet", 9.0)]
    assert rows(got.balance["value"], "season", "source_total", "target_total") == [("dry", 62.0, 62.0), ("wet", 31.5, 31.5)]


def test_ids_are_never_parsed(spark):
    odd = ["a|b", "x.y_1", "名前", " ", "0012", "NULL", 'q"uote']
    a = artifact(spark, [(f"T {u}", u, 1.0) for u in odd], "per_source")
    data = spark.createDataFrame([(u, float(i)) for i, u in enumerate(odd)], "unit_id string, value double")
    got = apply_weights(a, data, kind="extensive", weight="pop", data_version="units-v1").frame
    assert dict(rows(got, "adm0", "value")) == {f"T {u}": float(i) for i, u in enumerate(odd)}


def test_intensive_renormalises_to_units_with_a_value(spark):
    a = artifact(spark, [("FJ", "k1", 0.6), ("FJ", "k2", 0.2), ("FJ", "k3", 0.2)], "per_destination")
    run = lambda y: apply_weights(a, spark.createDataFrame([("k1", 5.0), ("k2", y), ("k3", 30.0)], "unit_id string, value double"), kind="intensive", weight="pop", data_version="units-v1").frame.first()["value"]
    assert run(10.0) == pytest.approx(3 + 2 + 6)
    assert run(float("nan")) == pytest.approx((3 + 6) / 0.8)


def test_ratio_is_of_totals(spark):
    a = artifact(spark, [("FJ", "k1", 0.25), ("FJ", "k2", 1.0), ("TO", "k1", 0.75)], "per_source")
    data = spark.createDataFrame([("k1", 8.0, 40.0), ("k2", 6.0, 10.0)], "unit_id string, lost double, made double")
    got = apply_weights(a, data, kind="ratio", weight="pop", data_version="units-v1", value_col="lost", denominator="made")
    assert rows(got.frame, "adm0", "lost") == [("FJ", pytest.approx((2 + 6) / (10 + 10))), ("TO", pytest.approx(0.2))]
    assert set(got.balance) == {"lost", "made"} and got.balance["made"].first()["target_total"] == 50.0


def test_units_of_zero_weight_lose_their_totals(spark):
    a = artifact(spark, [("FJ", "k1", 1.0), ("FJ", "k2", 0.0)], "per_source")
    data = spark.createDataFrame([("k1", 30.0), ("k2", 12.0)], "unit_id string, value double")
    run = lambda art, **k: apply_weights(art, data, kind="extensive", weight="pop", data_version="units-v1", **k)
    with pytest.raises(ValueError, match="zero_weight"):
        run(a)
    with pytest.raises(ValueError, match="don't balance"):
        run(a, coverage={"zero_weight": "skip"})
    missing = artifact(spark, [("FJ", "k1", 1.0), ("FJ", "k2", None)], "per_source")
    assert run(missing, coverage={"zero_weight": "skip"}).frame.first()["value"] == 30.0


def test_coverage_is_recorded_before_it_raises(spark, nested, tmp_path):
    data = spark.createDataFrame([("k1", 1.0), ("k8", 1.0)], "unit_id string, value double")
    with pytest.raises(ValueError, match="unmatched"):
        apply_weights(nested, data, kind="extensive", weight="pop", data_version="units-v1", record=str(tmp_path / "c"))
    found = json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()))["source_coverage"]
    assert found["unmatched"]["n"] == 1 and found["absent_from_data"]["n"] == 3
    with pytest.raises(ValueError, match="no status"):
        apply_weights(nested, data, kind="extensive", weight="pop", data_version="units-v1", coverage={"unmatchd": "skip"})


@pytest.mark.parametrize("change, message", [({"kind": "mean"}, "kind"), ({"kind": "intensive"}, "per_destination"), ({"data_version": "v0"}, "version"), ({"data_version": None}, "version"), ({"weight": "gdp"}, "gdp"), ({"denominator": "value"}, "denominator"), ({"group_col": "nope"}, "nope")])
def test_apply_refuses(spark, nested, change, message):
    data = spark.createDataFrame([(f"k{i}", 1.0) for i in range(1, 5)], "unit_id string, value double")
    with pytest.raises(ValueError, match=message):
        apply_weights(nested, data, **({"kind": "extensive", "weight": "pop", "data_version": "units-v1"} | change))


def test_apply_refuses_repeats_and_lost_units(spark, nested):
    run = lambda units, **k: apply_weights(nested, spark.createDataFrame([(u, 1.0) for u in units], "unit_id string, value double"), kind="extensive", weight="pop", data_version="units-v1", **k)
    with pytest.raises(ValueError, match="more than one row"):
        run(["k1", "k1", "k2", "k3", "k4"])
    with pytest.raises(ValueError, match="unmatched"):
        run(["k1", "k2", "k3", "k4", "k9"])
    with pytest.raises(ValueError, match="absent_from_data"):
        run(["k1", "k2", "k3"])
    got = run(["k1", "k9"], coverage={"unmatched": "skip", "absent_from_data": "skip"})
    assert rows(got.coverage, "unit_id", "status") == [("k2", "absent_from_data"), ("k3", "absent_from_data"), ("k4", "absent_from_data"), ("k9", "unmatched")]
    nested.partial_coverage = 2
    with pytest.raises(ValueError, match="partly covered"):
        run(["k1", "k2", "k3", "k4"])


def test_window_mean_comes_before_quantiles(spark):
    d = spark.createDataFrame([("a", 2050, 0.0), ("a", 2051, 10.0), ("b", 2050, 10.0), ("b", 2051, 0.0)], "k string, year int, value double")
    got = stats.summarize_samples(d, sample_dims=["k"], time_col="year", window=(2050, 2051), quantiles=(0.95,))
    assert rows(got, "statistic", "value") == [("mean", 5.0), ("q95", 5.0)]


@pytest.mark.parametrize("values, weights, q, want", [([3, 5, 6, 20], [2] * 4, 0.5, 5.5), ([4, 9], [3, 3], 0.2, -math.inf), ([4, 9, 12], [0, 5, 5], 0.3, 4.0), ([6, 6], [0.2, 0.8], 0.5, 6.0), ([6, 6], [0.8, 0.2], 0.5, -math.inf)])
def test_weighted_quantiles(spark, values, weights, q, want):
    d = spark.createDataFrame([(f"m{i}", float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights))], "z string, value double, w double")
    got = stats.pooled_statistics(d, sample_dims=["z"], quantiles=(q,), include_mean=False, weight_col="w").first()["value"]
    assert got == want


def test_weighted_mean_and_guards(spark):
    d = spark.createDataFrame([("a", 6.0, 0.25), ("b", 2.0, 0.75), ("c", 444.0, 0.0)], "z string, value double, w double")
    assert stats.pooled_statistics(d, sample_dims=["z"], weight_col="w").first()["value"] == 3.0
    for bad, message in ((d.withColumn("w", F.lit(-1.0)), "negative"), (d.withColumn("w", F.lit(0.0)), "zero"), (d.withColumn("q05", F.lit(1)), "statistics"), (d.union(d), "more than one row")):
        with pytest.raises(ValueError, match=message):
            stats.pooled_statistics(bad, sample_dims=["z"], weight_col="w")
    lone = d.withColumn("g", F.lit(1)).unionByName(d.withColumn("g", F.lit(2)).withColumn("value", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="no draw"):
        stats.pooled_statistics(lone, sample_dims=["z"], weight_col="w")
    assert rows(stats.pooled_statistics(lone.drop("w"), sample_dims=["z"]), "g", "value") == [(1, pytest.approx(452 / 3)), (2, None)]
    with pytest.raises(ValueError, match="reserved"):
        stats.pooled_statistics(d.withColumnRenamed("w", "_w"), sample_dims=["z"], weight_col="_w")
    with pytest.warns(stats.UnweightedModelWeightsWarning):
        stats.pooled_statistics(d.drop("w").withColumnRenamed("z", "gcm"), sample_dims=["gcm"])
    with pytest.raises(ValueError, match="reduced"):
        stats.window_means(d.withColumn("window", F.lit(1)).withColumn("t", F.lit(1)), time_col="t", windows=[(1, 2)])
    assert [stats.quantile_label(q) for q in (0.05, 0.5, 0.025)] == ["q05", "q50", "q2.5"]


def test_fallbacks(spark):
    spine = spark.createDataFrame([("P", 4, 0.2), ("P", 5, 0.8), ("Q", 4, 0.3), ("Q", 6, 0.7), ("R", 9, 0.1), ("R", 8, 0.9)], "r string, ix long, areawt double")
    raw = spark.createDataFrame([("P", 4, 6.0), ("P", 5, 18.0), ("Q", 6, 7.0)], "r string, ix long, raw double")
    run = lambda p: normalize.with_fallback(spine, raw, ["r", "ix"], ["r"], "pop", p)
    got = run("area")
    assert rows(got, "r", "ix", "popwt", "pop_method") == [("P", 4, 0.25, "native"), ("P", 5, 0.75, "native"), ("Q", 4, 0.0, "native"), ("Q", 6, 1.0, "native"), ("R", 8, 0.9, "area_fallback"), ("R", 9, 0.1, "area_fallback")]
    assert dict(rows(normalize.method_counts(got, ["r"], "pop"), "method", "n")) == {"native": 2, "area_fallback": 1}
    assert not normalize.dominant_fallback(got, ["r"], "pop") and normalize.dominant_fallback(got, ["r"], "pop", least=1)
    assert [r["popwt"] for r in run("nan").where("r = 'R'").collect()] == [None, None]
    with pytest.raises(ValueError, match="no positive total"):
        run("error")
    with pytest.raises(ValueError, match="lacks"):
        normalize.with_fallback(spine, raw.union(spark.createDataFrame([("S", 4, 1.0)], raw.schema)), ["r", "ix"], ["r"], "pop")
    with pytest.raises(ValueError, match="positive"):
        normalize.native_weights(raw.withColumn("raw", F.lit(0.0)), ["r"], "pop", "raw")
    schema = OutputSchema(("r",), ("pop",), SourceUnits(("ix",)), "per_destination")
    assert validate.sum_to_one(run("zero"), schema).count() == 1 and validate.sum_to_one(got, schema).count() == 0
    both = normalize.combined([got.select("r", "ix", "popwt"), raw.select("r", "ix", F.col("raw").alias("gdpwt"))], ["r", "ix"])
    assert both.count() == 6 and both.where("gdpwt IS NULL").count() == 3


def test_gradients(spark):
    w = spark.createDataFrame([("FJ", 3, "k", 0.4), ("FJ", 7, "k", 0.6), ("FJ", 7, "l", 1.0)], "iso string, id int, h string, popwt double")
    g = spark.createDataFrame([("k", [5.0, -10.0]), ("l", [2.0, 1.0])], "h string, gradient array<double>")
    got = gradients.aggregate_gradient(w, g, ids=["iso", "id"], keys=["h"], weight="pop")
    assert rows(got, "id", "gradient") == [(3, [2.0, -4.0]), (7, [5.0, -5.0])]
    d = gradients.delta_method(spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.0, -2.0])], "id int, gradient array<double>"), [[1, 0.5], [0.5, 9]])
    assert [x[1] for x in rows(d, "id", "sd")] == pytest.approx([math.sqrt(21), 6.0])
    with pytest.raises(ValueError, match="without weights"):
        gradients.aggregate_gradient(w.where("h = 'k'"), g, ids=["iso", "id"], keys=["h"], weight="pop")


def test_grid(spark):
    g = GridSpec(0.25)
    p = spark.createDataFrame([(10.1, -90.0), (180.0, 90.0), (-180.0, 0.3)], "lon double, lat double").select(g.ix(F.col("lon")), g.iy(F.col("lat"))).collect()
    assert [tuple(r) for r in p] == [(760, 0), (0, 719), (0, 361)]
    with pytest.raises(ValueError):
        GridSpec(0.85)
    b = spark.createDataFrame([("M", 20.5, -3.25, 22.25, -1.0), ("N", 7.0, 7.0, 8.0, 9.0)], "r string, x0 double, y0 double, x1 double, y1 double")
    got = box_cells(b, GridSpec(1.0), ["r"]).groupBy("r").agg(F.count("*").alias("n"), F.sum("planar_area").alias("a"))
    assert rows(got, "r", "n", "a") == [("M", 9, pytest.approx(1.75 * 2.25)), ("N", 2, 2.0)]
    with pytest.raises(Exception, match="no inside"):
        box_cells(b.selectExpr("r", "x1 AS x0", "y0", "x0 AS x1", "y1"), GridSpec(1.0), ["r"]).collect()
    assert uniform_resolution(spark.range(-3, 9).select((F.col("id") * 0.2).alias("x")), "x") == pytest.approx(0.2)
    for bad in ([0.0, 1.0, 2.5], [4.0]):
        with pytest.raises(ValueError):
            uniform_resolution(spark.createDataFrame([(x,) for x in bad], "x double"), "x")
    cells = spark.createDataFrame([("M", 5, 181, 0.5, 90.0), ("M", 5, 181, 0.5, 90.0)], "r string, cell_ix long, cell_iy long, cell_lon double, cell_lat double")
    found = validate.grid_problems(cells, 360, 180, ["r"])
    assert {r.problem: r.n for r in found.collect()} == {"ix": 0, "iy": 2, "lon": 0, "lat": 2, "duplicate": 2}
    with pytest.raises(ValueError, match="duplicate"):
        validate.enforce(found, "weights")
    with pytest.raises(Exception, match="outside the grid"):
        nearest_cell_rows(spark.createDataFrame([("M", 0.0, 95.0)], "r string, lon double, lat double"), cells.limit(0), GridSpec(1.0), ["r"], ["pop"]).collect()
    units = spark.createDataFrame([("k", 10.0), ("l", 4.0), ("m", 2.0)], "u string, area double")
    assert rows(covered_share(spark.createDataFrame([("k", 10.0), ("l", 1.0)], "u string, area_raw double"), units, ["u"]), "u", "share") == [("l", 0.25), ("m", 0.0)]


def test_legacy_tables(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "hierid string, pix_cent_x double, pix_cent_y double, cropwt double")
    ours = make([("FJ", 1.25, 2.25, 0.7), ("FJ", 1.75, 2.25, 0.3), ("TO", 5.25, 0.25, None), ("NU", 9.25, 9.25, 1.0)])
    legacy = make([("FJ", 1.25001, 2.25, 0.2), ("FJ", 2.25, 2.25, 0.8), ("TO", 5.25, 0.25, 1.0), ("WS", 0.25, 0.25, None)])
    report, regions = compare.legacy_comparison(ours, legacy)
    r = report.first()
    assert (r.regions, r.both_native, r.both_missing, r.ours_missing, r.legacy_missing, r.delta_max, r.displaced) == (4, 1, 1, 1, 1, 0.8, 1)
    (one,) = regions.collect()
    assert one.ours_cell == (1.25, 2.25) and one.legacy_cell == (2.25, 2.25)
    frame = spark.createDataFrame([("b", 0.5, 1.5, 0.25, 2.0), ("a", 0.5, 0.5, 1.0, 3.0), ("b", 1.5, 1.5, 0.75, 6.0)], "hierid string, cell_lon double, cell_lat double, popwt double, pop_raw double")
    compare.write_legacy_csv(frame, str(tmp_path / "l.csv"), names=("pop",))
    back = compare.read_legacy_csv(spark, str(tmp_path / "l.csv"))
    assert rows(back, "hierid", "pix_cent_x", "pop", "poptotal", "popwt", "shpid") == [("a", 0.5, 3.0, 3.0, 1.0, 0), ("b", 0.5, 2.0, 8.0, 0.25, 1), ("b", 1.5, 6.0, 8.0, 0.75, 1)]
    ids = spark.range(0, 30000, 7).select(F.col("id").alias("k"))
    assert compare.dense_ids(ids, "k").where("shpid <> k / 7").count() == 0


def test_products(spark, tmp_path):
    (tmp_path / "pop.csv").write_text("# source\n# note\nyear,unit,pop\n2020,k,5\n2025,k,8\n")
    assert rows(products.population(spark, str(tmp_path / "pop.csv"), (2023, 2026), id_col="unit"), "year", "pop") == [(2023, 5.0), (2024, 5.0), (2025, 8.0), (2026, 8.0)]
    (tmp_path / "x.csvv").write_text("gamma\n1,2\nresidvcv\n0.125\n")
    assert products.residual_variance(spark, str(tmp_path / "x.csvv")) == 0.125
    (tmp_path / "crops.csv").write_text("hierid,rice,maize\nk,4,0\nl,6,3\n")
    areas = products.amounts(spark, str(tmp_path / "crops.csv"), ["rice", "maize"])
    base = WeightsArtifact(spark.createDataFrame([("FJ", "k", 0.75), ("TO", "k", 0.25), ("TO", "l", 1.0)], "adm0 string, hierid string, areawt double"), OutputSchema(("adm0",), ("area",), SourceUnits(("hierid",)), "per_source"), "t", "u")
    made = products.crop_artifacts(base, areas, ["rice", "maize"])
    assert rows(made["rice"].frame, "adm0", "hierid", "croparea_raw", "cropareawt") == [("FJ", "k", 3.0, 1.0), ("TO", "k", 1.0, 1 / 7), ("TO", "l", 6.0, 6 / 7)]
    assert {r.croparea_method for r in made["maize"].frame.where("hierid = 'k'").collect()} == {"nan"}
    (tmp_path / "crops.csv").write_text("hierid,rice\nk,4\nk,6\n")
    with pytest.raises(ValueError, match="more than one row"):
        products.amounts(spark, str(tmp_path / "crops.csv"), ["rice"])
    pairs = spark.createDataFrame([("k", 1, "d1", 6.0, 3.0), ("k", 1, "d2", 8.0, 4.0), ("k", 2, "d1", 1.0, 0.0), ("k", 3, "d1", 20.0, 5.0), ("k", 4, "d1", 1.0, 0.0)], "u string, year int, draw string, a double, b double")
    assert rows(products.implied_factor(pairs, ["u"], over="a", under="b"), "year", "factor") == [(1, 2.0), (2, 3.0), (3, 4.0), (4, 4.0)]
    with pytest.raises(ValueError, match="differs"):
        products.implied_factor(pairs.withColumn("a", F.when(F.col("draw") == "d2", 99.0).otherwise(F.col("a"))), ["u"], over="a", under="b")
    f = spark.createDataFrame([("USA.7.12_1",), ("GBR.1_2",)], "c string").select(products.parent_code("c").alias("p"))
    assert rows(f, "p") == [("GBR_2",), ("USA.7_1",)]
    with pytest.raises(ValueError, match="unit"):
        products.scaled("x", "yards")
    assert montecarlo.frequent(["b", "a", "b", "c", "a", "b"], 2) == [("b", 3), ("a", 2)]


def test_siblings_members_and_merge(spark):
    a = spark.createDataFrame([("u", 1, 5.0), ("v", None, 7.0)], "unit string, y int, value double")
    b = spark.createDataFrame([("u", 1, 2.0), ("v", None, 3.0)], a.schema)
    assert rows(regroup.subtract(a, b), "unit", "value") == [("u", 3.0), ("v", 4.0)]
    with pytest.raises(ValueError, match="without a partner"):
        regroup.subtract(a.limit(1), b)
    table = spark.createDataFrame([("Aurora*", 0.5), ("surrogate_x", 0.5)], "model string, weight double")
    leaf = spark.createDataFrame([("aurora",), ("surrogate_X",)], "gcm string")
    assert [r["model_weight"] for r in regroup.attach_member_weights(leaf, table, "gcm").collect()] == [0.5, 0.5]
    with pytest.raises(ValueError, match="without a weight"):
        regroup.attach_member_weights(leaf.union(spark.createDataFrame([("other",)], leaf.schema)), table, "gcm")
    schema = OutputSchema(("id",), ("pop",), UNIT, "per_destination")
    w = spark.createDataFrame([("A", "u", 1.0, 1.0, "native")], schema.struct)
    merged = compare.merge_weights(w, w.withColumn("id", F.lit("B")), schema, id_col="id", expected_total=2)
    assert rows(merged, "id", "source") == [("A", "canonical"), ("B", "supplement")]
    with pytest.raises(ValueError, match="both sets"):
        compare.merge_weights(w, w, schema, id_col="id")
    line = spark.createDataFrame([("s", 1, 1.0), ("s", 2, None), ("s", 4, 4.0)], "k string, t int, value double")
    assert [r[1] for r in rows(regroup.interpolated(line, ["k"], "t", "value"), "t", "value")] == [1.0, 2.0, 4.0]


def test_tree_runs_as_one_plan(spark, tmp_path):
    root = tmp_path / "tree"
    levels = {"rcp": ["r1", "r2"], "gcm": ["m1", "m2"]}
    tree = montecarlo.Tree(str(root), "damages.parquet", ["rcp", "gcm"], levels, exclude=[{"rcp": "r2", "gcm": "m2"}])
    for i, leaf in enumerate(tree.leaves()):
        d = [(u, y, base * (i + 1) + 2 * (y - 2080)) for u, base in (("k1", 30.0), ("k2", 8.0)) for y in (2080, 2081, 2082)]
        spark.createDataFrame(d, "unit_id string, year int, value double").coalesce(1).write.parquet(tree.path(leaf))
    a = artifact(spark, [("FJ", "k1", 1.0), ("FJ", "k2", 0.25), ("TO", "k2", 0.75)], "per_source")
    args = dict(kind="extensive", weight="pop", data_version="units-v1", windows=[(2080, 2082)], sample_dims=["rcp", "gcm"])
    assert len(montecarlo.run_pipeline(spark, tree, a, dry_run=True, **args)) == 3
    with pytest.warns(stats.UnweightedModelWeightsWarning):
        got = montecarlo.run_pipeline(spark, tree, a, output=str(tmp_path / "out"), keep_leaves=True, **args)
    assert rows(got, "adm0", "value") == [("FJ", pytest.approx(60 + 2 + (16 + 2) / 4)), ("TO", pytest.approx((16 + 2) * 0.75))]
    account = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert account["leaves"] == 3 and account["rows"] == 2 and (tmp_path / "out" / "leaves" / "rcp=r1" / "gcm=m2").exists()
    assert montecarlo.draws(spark, str(root)) == ["r1", "r2"]
    for i, leaf in enumerate(tree.leaves()):
        spark.read.parquet(tree.path(leaf)).coalesce(1).write.option("header", True).csv(tree.path(leaf, "damages.csv"))
    same = montecarlo.Tree(str(root), "damages.csv", ["rcp", "gcm"], levels, exclude=tree.exclude)
    with pytest.warns(stats.UnweightedModelWeightsWarning):
        assert rows(montecarlo.run_pipeline(spark, same, a, fmt="csv", **args), "adm0", "value") == rows(got, "adm0", "value")
    write_artifact(a, str(tmp_path / "w"))
    (tmp_path / "models.tsv").write_text("model\tweight\nM1*\t0.5\nsurrogate_m2\t0.5\n")
    (tmp_path / "p.toml").write_text('[tree]\nroot = "tree"\nfilename = "damages.parquet"\nlevels = ["rcp", "gcm"]\nexpect = {rcp = ["r1"], gcm = ["m1", "m2"]}\n[weights]\npath = "w"\nweight = "pop"\n[data]\nkind = "extensive"\nversion = "units-v1"\n[stats]\nwindows = [[2080, 2081]]\nsample_dims = ["gcm"]\nmodel_weights = "models.tsv"\nlevel = "gcm"\n[output]\ndir = "done"\n')
    assert len(montecarlo.run_config(spark, str(tmp_path / "p.toml"), dry_run=True)) == 2
    assert rows(montecarlo.run_config(spark, str(tmp_path / "p.toml")), "adm0", "value") == [("FJ", pytest.approx(45 + 1 + (12 + 1) / 4)), ("TO", pytest.approx(13 * 0.75))]
    (tmp_path / "models.tsv").write_text("model\tweight\nM1\t1\n")
    with pytest.raises(ValueError, match="without a weight"):
        montecarlo.run_config(spark, str(tmp_path / "p.toml"))
    for bad, message in (("[tree]\ncolour = 1\n", "unknown"), ("[data]\nkind = 'ratio'\n", "lacks")):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError, match=message):
            montecarlo.load_config(str(tmp_path / "bad.toml"))
    with pytest.raises(ValueError, match="region_dim"):
        montecarlo.check_data({"format": "netcdf"})
    lost = montecarlo.Tree(str(root), "other.parquet", ["rcp", "gcm"], levels)
    with pytest.raises(FileNotFoundError):
        montecarlo.run_pipeline(spark, lost, a, **args)
    with pytest.raises(ValueError):
        montecarlo.Tree("x", "y", ["a"], {"b": ["c"]})


def test_artifact_round_trip(spark, tmp_path):
    schema = OutputSchema(("id",), ("pop",), UNIT, "per_source")
    w = spark.createDataFrame([("A", "u", 1.0, 1.0, "native")], schema.struct)
    schema.validate(w)
    write_artifact(WeightsArtifact(w, schema, "t1", "u1"), str(tmp_path), "both")
    got = load_artifact(spark, str(tmp_path))
    assert got.schema == schema and got.source_version == "u1" and rows(got.frame, "id", "popwt") == [("A", 1.0)]
    with pytest.raises(ValueError, match="lack"):
        schema.validate(w.drop("popwt"))
