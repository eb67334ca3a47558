"""Areas, clipping, overlaps and points of polygons, by hand-computed shapes."""

import struct

import numpy as np
import pytest

from tessella.functions import rings as rg
from tessella.operators import polygons as pg
from tessella.operators import zonal
from tessella.operators.grid import GridSpec, cell_areas
from tessella.plans import generate


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


FRAME = rg.to_wkb([box(-7, 3, -2, 6), box(-6.5, 3.5, -2.5, 5.5)])


def layer(spark):
    rows = [("block", rg.to_wkb([box(10, -3, 13, -1)])), ("speck", rg.to_wkb([box(11.25, -2.75, 11.5, -2.25)])), ("frame", FRAME), ("nothing", None)]
    return spark.createDataFrame([(a, None if g is None else bytearray(g)) for a, g in rows], "name string, geometry binary")


def test_areas():
    assert rg.planar_area(rg.from_wkb(FRAME)) == pytest.approx(15 - 8)
    strip = [np.array(box(x, -90, x + 20, 90), float) for x in range(-180, 180, 20)]
    assert rg.geodesic_area(strip) == pytest.approx(510065621724089, rel=1e-9)
    assert rg.geodesic_area(rg.from_wkb(rg.to_wkb([box(40, 0, 41, 1)]))) == pytest.approx(12308778361, rel=1e-4)


def test_overlap_of_shapes_that_are_not_convex():
    comb = [(0, 0), (9, 0), (9, 5), (7, 5), (7, 1), (5, 1), (5, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5)]
    one, two = rg.from_wkb(rg.to_wkb([comb])), rg.from_wkb(rg.to_wkb([box(0.5, 0.5, 6, 3), box(3.5, 1.5, 4.5, 2.5)]))
    want = 5.5 * 0.5 + 0.5 * 2 + 2 * 2 - 1
    for x, y in ((one, two), (two, one)):
        assert rg.overlap(x, y, rg.signed_area) == pytest.approx(want) and rg.planar_area(rg.intersection(x, y)) == pytest.approx(want)
    assert rg.overlap(one, rg.from_wkb(rg.to_wkb([box(20, 20, 21, 22)]))) == 0 and rg.intersection(one, rg.from_wkb(rg.to_wkb([box(20, 20, 21, 22)]))) == []


def test_arrangements_add_up():
    rng = np.random.default_rng(5)
    for _ in range(60):
        two = []
        for _ in range(2):
            turn = np.sort(rng.random(rng.integers(3, 9))) * 2 * np.pi
            star = np.stack([np.cos(turn), np.sin(turn)], 1) * (rng.random(len(turn)) * 2 + 0.2)[:, None] + rng.random(2)
            two.append([rg._open(star, True)])
        a, b = two
        if not (rg.is_valid(a) and rg.is_valid(b)):
            continue
        both = rg.planar_area(rg.intersection(a, b))
        assert both == pytest.approx(rg.overlap(a, b, rg.signed_area), abs=1e-9)
        assert rg.planar_area(rg.union([a, b])) + both == pytest.approx(rg.planar_area(a) + rg.planar_area(b), abs=1e-9)
        assert rg.contains(a, *(np.array([x]) for x in rg.inner_point(a))).all()


def test_union_of_neighbours_and_repair():
    (ring,) = rg.union([[np.array(box(i, j, i + 1, j + 1), float)] for i in range(3) for j in range(2)])
    assert len(ring) == 4 and rg.signed_area(ring) == 6
    shell, hole = sorted(rg.union([[np.array(b, float)] for b in (box(0, 0, 5, 1), box(0, 2, 5, 3), box(0, 0, 1, 3), box(4, 0, 5, 3))]), key=rg.signed_area, reverse=True)
    assert rg.signed_area(shell) == 15 and rg.signed_area(hole) == -3 and rg.planar_area(rg.from_wkb(rg.wkb_of([shell, hole]))) == 12
    bow = [np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)]
    assert not rg.is_valid(bow) and rg.planar_area(rg.repaired(bow)) == 8 and len(rg.repaired(bow)) == 2 and rg.is_valid([shell, hole])


def test_points_on_an_edge_are_outside():
    square = [np.array(box(0, 0, 2, 2), float)]
    x, y = np.array([1, 0, 2, 1, 1, 0, 3]), np.array([1, 1, 1, 0, 2, 0, 1])
    assert rg.contains(square, x.astype(float), y.astype(float)).tolist() == [True] + [False] * 6


def test_cells(spark):
    rows = pg.cells(layer(spark), ["name"], GridSpec(0.5)).collect()
    block = [r for r in rows if r.name == "block"]
    assert len(block) == 6 * 4 and all(r.fraction == 1 and r.is_interior for r in block)
    assert sum(r.fraction for r in rows if r.name == "frame") * 0.25 == pytest.approx(7)
    assert sorted((r.cell_ix, r.cell_iy, r.fraction) for r in rows if r.name == "speck") == [(382, 174, 0.25), (382, 175, 0.25)]
    shapes = pg.cells(layer(spark), ["name"], GridSpec(3.0), shapes=True).where("name = 'frame'").collect()
    assert all(rg.planar_area(rg.from_wkb(bytes(r.geometry))) == pytest.approx(9 * r.fraction) for r in shapes) and not any(r.is_interior for r in shapes)


def test_antimeridian(spark):
    two = rg.to_wkb([box(-180, 10, -178.5, 11)], [box(177, 10, 180, 11)])
    df = spark.createDataFrame([("far", bytearray(two))], "name string, geometry binary")
    assert len(rg.hemispheres(rg.from_wkb(two))) == 2
    got = {(r.cell_ix, r.fraction) for r in pg.cells(df, ["name"], GridSpec(1.0)).collect()}
    assert got == {(0, 1.0), (1, 0.5), (357, 1.0), (358, 1.0), (359, 1.0)}


def test_cells_at_longitude_zero_come_once(spark):
    belt = rg.to_wkb([box(-180, 10, 180, 11)])
    df = spark.createDataFrame([("belt", bytearray(belt))], "name string, geometry binary")
    got = pg.cells(df, ["name"], GridSpec(1.0, "center")).where("cell_iy = 100").collect()
    assert len({r.cell_ix for r in got}) == len(got) == 360 and all(r.fraction == pytest.approx(0.5) for r in got)
    twice = spark.createDataFrame([("a", 1, 2, 3.0), ("a", 1, 2, 5.0)], "name string, cell_ix long, cell_iy long, area_raw double")
    assert [r.area_raw for r in cell_areas(twice, ["name"]).collect()] == [5.0]
    assert pg.digest(df, ["name"]) != pg.digest(df.selectExpr("'x' AS name", "geometry"), ["name"])


def test_geometries_of_other_kinds():
    point, line = b"\1" + struct.pack("<I2d", 1, 3.0, 4.0), b"\0" + struct.pack(">II4d", 2, 2, 0, 0, 1, 1)
    ring = [(0, 0, 9), (2, 0, 9), (2, 1, 9), (0, 1, 9), (0, 0, 9)]
    solid = b"\1" + struct.pack("<III", 1003, 1, 5) + b"".join(struct.pack("<3d", *p) for p in ring)
    whole = b"\1" + struct.pack("<II", 7, 3) + point + solid + line
    assert rg.planar_area(rg.from_wkb(whole)) == 2 and rg.from_wkb(point) == [] and rg.from_wkb(line) == []


def test_overlay(spark):
    zones = {"left": box(-20, 30, -15, 36), "right": box(-15, 30, -9, 36)}
    lots = {"in": box(-18.5, 31.25, -17.75, 33.5), "across": box(-16, 32, -13, 33), "edge": box(-9, 30, -8, 31), "far": box(100, 0, 101, 1)}
    make = lambda d, c: spark.createDataFrame([(k, bytearray(rg.to_wkb([v]))) for k, v in d.items()], f"{c} string, geometry binary")
    got = {(r.zone, r.lot): r.area_raw for r in pg.overlay(make(zones, "zone"), ["zone"], make(lots, "lot"), ["lot"]).collect()}
    area = lambda b: rg.geodesic_area(rg.from_wkb(rg.to_wkb([b])))
    assert got == {("left", "in"): pytest.approx(area(lots["in"]), rel=1e-9), ("left", "across"): pytest.approx(area(box(-16, 32, -15, 33)), rel=1e-9), ("right", "across"): pytest.approx(area(box(-15, 32, -13, 33)), rel=1e-9)}
    shapes = pg.overlay(make(zones, "zone"), ["zone"], make(lots, "lot"), ["lot"], shapes=True, bin_degrees=0.4).collect()
    assert sum(rg.planar_area(rg.from_wkb(bytes(r.geometry))) for r in shapes) == pytest.approx(0.75 * 2.25 + 3)
    with pytest.raises(ValueError, match="both sides"):
        pg.overlay(make(zones, "zone"), ["zone"], make(lots, "zone"), ["zone"])


def test_points_and_domain(spark):
    points = spark.createDataFrame([(1, 11.375, -2.5), (2, -4.5, 4.5), (3, -6.75, 4.0), (4, 60.0, 9.0), (5, None, 1.0), (6, 12.0, -2.0), (7, 10.0, -2.0)], "id int, lon double, lat double")
    got = sorted((r.id, r.name) for r in pg.points_in(points, layer(spark), ["name"]).collect())
    assert got == [(1, "block"), (1, "speck"), (3, "frame"), (6, "block")]
    assert pg.outside_domain(layer(spark)).count() == 0
    near = spark.createDataFrame([("n", bytearray(rg.to_wkb([box(-180.00005, 0, -179, 1)])))], "name string, geometry binary")
    assert [r.overshoot for r in pg.domain_edge(near, ["name"], "zones").collect()] == [pytest.approx(5e-5)]
    far = spark.createDataFrame([("n", bytearray(rg.to_wkb([box(200, 0, 201, 1)])))], "name string, geometry binary")
    with pytest.raises(ValueError, match="outside"):
        pg.domain_edge(far, ["name"], "zones")


def test_invalid_polygons_by_policy(spark):
    bow = bytearray(rg.to_wkb([[(0, 0), (4, 4), (4, 0), (0, 4)]]))
    df = spark.createDataFrame([("bow", bow), ("good", bytearray(rg.to_wkb([box(0, 0, 1, 1)]))), ("null", None)], "name string, geometry binary")
    fixed, account = pg.mended(df, ["name"])
    assert {r.name: rg.planar_area(rg.from_wkb(bytes(r.geometry))) for r in fixed.collect()} == {"bow": 8, "good": 1}
    assert sorted(tuple(r) for r in account.collect()) == [("bow", "invalid"), ("null", "null")]
    assert [r.name for r in pg.mended(df, ["name"], "skip")[0].collect()] == ["good"]
    with pytest.raises(ValueError, match="invalid"):
        pg.mended(df, ["name"], "error")


def test_dissolve(spark):
    rows = [("p", "x", i, bytearray(rg.to_wkb([box(i, 0, i + 1, 2)]))) for i in range(4)] + [("q", "y", 9, bytearray(rg.to_wkb([box(50, 0, 51, 1)])))]
    df = spark.createDataFrame(rows, "k string, name string, i int, geometry binary")
    got = {r.k: r for r in pg.dissolved(df, ["k"], names=("name",)).collect()}
    assert got["p"].union_area == 8 and got["p"].pieces == 4 and got["p"].name == "x" and len(rg.from_wkb(bytes(got["p"].geometry))[0]) == 4
    with pytest.raises(ValueError, match="conserved"):
        pg.dissolved(df.unionByName(df.limit(1)), ["k"])
    with pytest.raises(ValueError, match="null keys"):
        pg.dissolved(df.selectExpr("nullif(k, 'q') AS k", "geometry"), ["k"])
    with pytest.raises(ValueError, match="lacks"):
        pg.dissolved(df, ["zone"])


def test_zonal_sums(spark):
    pixels = GridSpec(1.0)
    points = spark.createDataFrame([(x + 0.5, y + 0.5, float(1 + x + 10 * y)) for x in range(6) for y in range(4)] + [(0.5, 0.5, -99.0)], "lon double, lat double, value double")
    raster = zonal.pixels(points, pixels, nodata=-99.0)
    df = spark.createDataFrame([("a", bytearray(rg.to_wkb([box(0.25, 0, 2.75, 1.5)]))), ("off", bytearray(rg.to_wkb([box(90, 40, 91, 41)])))], "cell_ix string, geometry binary")
    value = lambda x, y: 1 + x + 10 * y
    exact = sum(value(x, y) * w * h for x, w in ((0, 0.75), (1, 1), (2, 0.75)) for y, h in ((0, 1), (1, 0.5)))
    assert {r.cell_ix: r.raw for r in zonal.zonal_sums(df, ["cell_ix"], raster, pixels).collect()} == {"a": pytest.approx(exact), "off": 0}
    centre = {r.cell_ix: r.raw for r in zonal.zonal_sums(df, ["cell_ix"], raster, pixels, coverage="pixel_centroid").collect()}
    assert centre == {"a": sum(value(x, 0) for x in range(3)), "off": 0}
    area = [rg.geodesic_area([np.array(box(0, y, 1, y + 1), float)]) for y in range(2)]
    weighted = {r.cell_ix: r.raw for r in zonal.zonal_sums(df, ["cell_ix"], raster, pixels, kind="area_weighted_sum").collect()}
    assert weighted["a"] == pytest.approx(sum(value(x, y) * w * h * area[y] for x, w in ((0, 0.75), (1, 1), (2, 0.75)) for y, h in ((0, 1), (1, 0.5))))
    with pytest.raises(ValueError, match="coverage"):
        zonal.zonal_sums(df, ["cell_ix"], raster, pixels, coverage="all")


def test_generation(spark):
    grid = GridSpec(2.0)
    people = zonal.pixels(spark.createDataFrame([(x + 0.5, y + 0.5, float(x)) for x in range(8) for y in range(2)], "lon double, lat double, value double"), GridSpec(1.0))
    zones = spark.createDataFrame([("empty", bytearray(rg.to_wkb([box(40, 40, 42, 42)]))), ("zone", bytearray(rg.to_wkb([box(1, 0, 6, 2)])))], "id string, geometry binary")
    weights = [generate.Weight("area"), generate.Weight("pop", people, GridSpec(1.0), fallback="area")]
    a = generate.weights_on_grid(zones, ["id"], grid, weights, regions_version="z-1")
    got = {(r.id, r.cell_ix): r for r in a.frame.collect()}
    assert set(got) == {("empty", 110), ("zone", 90), ("zone", 91), ("zone", 92)}
    assert [got["zone", i].popwt for i in (90, 91, 92)] == [pytest.approx(x / 15) for x in (1, 5, 9)] and got["zone", 90].areawt == pytest.approx(0.2, rel=1e-4)
    assert got["empty", 110].pop_method == "area_fallback" and a.manifest["fallback_counts"]["pop"] == {"native": 1, "area_fallback": 1}
    sliver = zones.unionByName(spark.createDataFrame([("tiny", bytearray(rg.to_wkb([box(3, 1, 3.000001, 1.000001)])))], zones.schema))
    small = generate.weights_on_grid(sliver, ["id"], grid, weights[:1], min_segment_m2=1.0).frame.where("id = 'tiny'").collect()
    assert [(r.cell_ix, r.areawt, r.area_method) for r in small] == [(91, 1.0, "nearest_cell")]
    lots = spark.createDataFrame([("in", bytearray(rg.to_wkb([box(1, 0, 3, 1)]))), ("half", bytearray(rg.to_wkb([box(5, 0, 7, 1)]))), ("none", bytearray(rg.to_wkb([box(80, 0, 81, 1)])))], "lot string, geometry binary")
    make = lambda **k: generate.weights_on_polygons(zones, ["id"], lots, ["lot"], weights, normalization="per_source", regions_version="z-1", source_version="l-1", **k)
    with pytest.raises(ValueError, match="overlap no region"):
        make()
    b = make(on_zero_overlap="skip")
    assert {r.lot: (r.areawt, r.popwt, r.pop_raw) for r in b.frame.collect()} == {"in": (1.0, 1.0, 3.0), "half": (1.0, 1.0, 5.0)}
    assert b.partial_coverage == 1 and b.manifest["zero_overlap_count"] == 1 and b.manifest["empty_regions"] == [["empty"]]
    for change, message in (({"weights": []}, "different names"), ({"source_ids": ["id"]}, "both name"), ({"source_version": ""}, "versions")):
        args = {"weights": weights, "source_ids": ["lot"], "source_version": "l-1"} | change
        with pytest.raises(ValueError, match=message):
            generate.weights_on_polygons(zones, ["id"], lots, regions_version="z", **args)
    with pytest.raises(ValueError, match="unknown"):
        generate.weights_on_grid(zones, ["id"], grid, weights[:1], requested=spark.createDataFrame([("zone",), ("atlantis",)], "id string"))
