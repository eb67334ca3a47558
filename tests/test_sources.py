"""Readers, writers, registry and command line against small files made here."""

import functools
import hashlib
import http.server
import json
import struct
import threading
import zlib

import numpy as np
import pytest

from tessella import cli
from tessella.functions import rings as rg
from tessella.plans import config, montecarlo, targets
from tessella.plans.schema import OutputSchema, SourceUnits, WeightsArtifact
from tessella.sources import artifacts, netcdf, raster, registry, vector, zarr


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def pad(b):
    return b + b"\0" * (-len(b) % 4)


def name(s):
    return struct.pack(">I", len(s)) + pad(s.encode())


def classic(dims, variables, records=0):
    """A CDF-1 file: dims [(name, size or 0)], variables {name: (dims, array, attrs)}."""
    codes = {"S": 2, "i": 4, "f": 5, "d": 6}
    head = b"CDF\x01" + struct.pack(">I", records) + struct.pack(">II", 10, len(dims)) + b"".join(name(n) + struct.pack(">I", s) for n, s in dims) + struct.pack(">II", 0, 0)
    order = [n for n, _ in dims]
    bodies, specs = [], []
    for n, (on, x, attrs) in variables.items():
        x = np.asarray(x)
        code = codes[x.dtype.char if x.dtype.kind != "S" else "S"]
        atts = struct.pack(">II", 12, len(attrs)) if attrs else struct.pack(">II", 0, 0)
        for k, v in attrs.items():
            atts += name(k) + (struct.pack(">II", 2, len(v)) + pad(v.encode()) if isinstance(v, str) else struct.pack(">IIf", 5, 1, v))
        body = x.tobytes() if code == 2 else x.astype(netcdf.TYPES[code]).tobytes()
        specs.append((name(n) + struct.pack(">I", len(on)) + b"".join(struct.pack(">I", order.index(d)) for d in on) + atts + struct.pack(">II", code, len(pad(body)))))
        bodies.append((bool(on) and dict(dims)[on[0]] == 0, body))
    start = len(head) + 8 + sum(len(s) + 4 for s in specs)
    fixed = [pad(b) for r, b in bodies if not r]
    place, out = start, b""
    at_record = start + sum(map(len, fixed))
    slots, offset = [], 0
    many = sum(r for r, _ in bodies) > 1
    for r, b in bodies:
        if r:
            size = len(b) // records
            slots.append((at_record + offset, b, size))
            offset += len(pad(b"\0" * size)) if many else size
        else:
            slots.append((place, None, 0))
            place += len(pad(b))
    out = head + struct.pack(">II", 11, len(specs)) + b"".join(s + struct.pack(">I", p) for s, (p, _, _) in zip(specs, slots)) + b"".join(fixed)
    for i in range(records):
        for _, b, size in slots:
            if b is not None:
                piece = b[i * size : (i + 1) * size]
                out += pad(piece) if many else piece
    return out


def test_netcdf_leaves(spark, tmp_path):
    labels = np.array([list(b"kappa"), list(b"mu\0\0\0")], "u1").view("S1").reshape(2, 5)
    x = np.array([[1.5, -9], [2.5, 4], [8, 16]], "f")
    for leaf, scale in (("a", 1), ("b", 10)):
        (tmp_path / leaf).mkdir()
        data = classic([("year", 0), ("region", 2), ("chars", 5)], {"year": (["year"], np.array([2031, 2032, 2033], "i"), {}), "names": (["region", "chars"], labels, {}), "loss": (["year", "region"], x * scale, {"units": "% of sales", "_FillValue": -9.0 * scale})}, records=3)
        (tmp_path / leaf / "run.nc").write_bytes(data)
    paths = [str(tmp_path / leaf / "run.nc") for leaf in "ab"]
    options = {"region_dim": "region", "region_col": "unit", "region_labels": "names"}
    got = netcdf.read_leaves(spark, paths, ["loss"], **options)
    rows = sorted((r.unit, r.year, None if r.loss != r.loss else r.loss) for r in got.collect())
    assert rows == sorted((u, 2031 + i, None if (i, j) == (0, 1) else float(x[i, j] * s)) for s in (1, 10) for i in range(3) for j, u in enumerate(("kappa", "mu")))
    for change, message in (({"kind": "extensive"}, "units"), ({"region_dim": "depth"}, "dimension"), ({"region_labels": "loss"}, "lies on"), ({"region_labels": "no"}, "no variable"), ({"region_col": "loss"}, "there already")):
        with pytest.raises(ValueError, match=message):
            netcdf.read_leaves(spark, paths, ["loss"], **(options | change))
    with pytest.raises(ValueError, match="variables"):
        netcdf.read_leaves(spark, paths, ["gain"], **options)
    with pytest.raises(ValueError, match="classic"):
        netcdf.Classic(b"\x89HDF")
    tree = montecarlo.Tree(str(tmp_path), "run.nc", ["draw"], {"draw": ["a", "b"]})
    leaves = montecarlo.read_leaves(spark, tree, "netcdf", netcdf={"variables": ["loss"], "region_dim": "region", "region_labels": "names"}, region_col="unit")
    assert {r.draw for r in leaves.select("draw").distinct().collect()} == {"a", "b"} and leaves.count() == 12
    wide = spark.createDataFrame([("a", 1.0, None), ("b", float("nan"), 4.0)], "k string, p double, q double")
    assert sorted(tuple(r) for r in netcdf.melted(wide, ["k"], ["p", "q"]).collect()) == [("a", "p", 1.0), ("b", "q", 4.0)]


def test_gradient_leaf(spark, tmp_path):
    g = np.arange(12.0).reshape(3, 2, 2)
    vcv = np.eye(3)
    dims = [("coefficient", 3), ("year", 2), ("region", 2), ("other", 3)]
    parts = {"year": (["year"], np.array([2050, 2051], "i"), {}), "slope": (["coefficient", "year", "region"], g, {}), "vcv": (["coefficient", "other"], vcv, {}), "sd": (["year", "region"], np.arange(4.0).reshape(2, 2), {})}
    (tmp_path / "g.nc").write_bytes(classic(dims, parts))
    names = {"variable": "slope", "vcv_variable": "vcv", "value_variable": "sd"}
    rows, v = netcdf.gradient_leaf(spark, str(tmp_path / "g.nc"), year=2051, **names)
    assert sorted((r.region, r.gradient, r.stored_variance) for r in rows.collect()) == [("0", [2.0, 6.0, 10.0], 2.0), ("1", [3.0, 7.0, 11.0], 3.0)] and v == vcv.tolist()
    with pytest.raises(ValueError, match="year"):
        netcdf.gradient_leaf(spark, str(tmp_path / "g.nc"), year=1999, **names)


def tiff(values, lon, lat, step, nodata=None, deflate=False, tiles=0):
    values = np.asarray(values, "<f4")
    h, w = values.shape
    pack = zlib.compress if deflate else bytes
    if tiles:
        across, down = -(-w // tiles), -(-h // tiles)
        grid = np.zeros((down * tiles, across * tiles), "<f4")
        grid[:h, :w] = values
        blocks = [pack(grid[i * tiles : (i + 1) * tiles, j * tiles : (j + 1) * tiles].tobytes()) for i in range(down) for j in range(across)]
    else:
        blocks = [pack(values[i : i + 2].tobytes()) for i in range(0, h, 2)]
    text = f"{nodata}\0".encode() if nodata is not None else None
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [32]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (339, "H", [3])]
    tags += [(322, "H", [tiles]), (323, "H", [tiles])] if tiles else [(278, "H", [2])]
    n = len(blocks)
    extra = b"".join(blocks)
    base = 8 + len(extra)
    at, places = 8, []
    for b in blocks:
        places.append(at)
        at += len(b)
    tags += [(324 if tiles else 273, "I", places), (325 if tiles else 279, "I", [len(b) for b in blocks]), (33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, lon, lat, 0.0])]
    tags.sort()
    body, entries = b"", b""
    fixed = base + 2 + 12 * (len(tags) + (text is not None)) + 4
    for tag, kind, x in tags + ([(42113, "s", text)] if text else []):
        code = {"H": 3, "I": 4, "d": 12, "s": 2}[kind]
        raw = x if kind == "s" else struct.pack("<" + kind * len(x), *x)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", fixed + len(body))
        body += b"" if len(raw) <= 4 else raw
        entries += struct.pack("<HHI", tag, code, len(x)) + place
    assert n
    return b"II*\0" + struct.pack("<I", base) + extra + struct.pack("<H", len(tags) + (text is not None)) + entries + b"\0" * 4 + body


@pytest.mark.parametrize("deflate, tiles", [(False, 0), (True, 0), (True, 16)])
def test_tiff_points(spark, tmp_path, deflate, tiles):
    values = np.arange(15.0).reshape(5, 3)
    values[2, 1] = -1
    (tmp_path / "r.tif").write_bytes(tiff(values, 10.0, 50.0, 0.5, nodata=-1.0, deflate=deflate, tiles=tiles))
    got = {(r.lon, r.lat): r.value for r in raster.points(spark, str(tmp_path / "r.tif")).collect()}
    assert got == {(10.25 + 0.5 * x, 49.75 - 0.5 * y): float(values[y, x]) for y in range(5) for x in range(3) if (y, x) != (2, 1)}
    assert raster.points(spark, str(tmp_path / "r.tif"), (10.0, 49.0, 10.5, 50.0)).count() == 2
    assert raster.value_column("pop") == "population" and raster.value_column("gdp") == "gdp"


def shapefile(folder, rows, prj=True):
    shp, index = b"", 0
    for ring in rows:
        closed = np.array([*ring, ring[0]], "<f8")[::-1]
        body = struct.pack("<i4d2i", 5, *closed.min(axis=0), *closed.max(axis=0), 1, len(closed)) + struct.pack("<i", 0) + closed.tobytes()
        index += 1
        shp += struct.pack(">2i", index, len(body) // 2) + body
    (folder / "l.shp").write_bytes(b"\0" * 100 + shp)
    fields = [("ISO", "C", 4, 0), ("NUM", "N", 6, 0), ("SHARE", "N", 8, 3)]
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + 18)
    head += b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([s, d]) + b"\0" * 14 for n, k, s, d in fields) + b"\r"
    body = b"".join(b" " + f"R{i}".ljust(4).encode() + str(i).rjust(6).encode() + f"{i / 8:.3f}".rjust(8).encode() for i in range(len(rows)))
    (folder / "l.dbf").write_bytes(head + body)
    if prj:
        (folder / "l.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')


def test_layers(spark, tmp_path):
    shapefile(tmp_path, [box(0, 0, 3, 2), box(5, 5, 6, 7)])
    df = vector.read_regions(spark, str(tmp_path / "l.shp"), ids=["ISO"], need_crs=True)
    got = sorted((r.ISO, r.NUM, r.SHARE, rg.planar_area(rg.from_wkb(bytes(r.geometry)))) for r in df.collect())
    assert got == [("R0", 0, 0.0, 6.0), ("R1", 1, 0.125, 2.0)]
    with pytest.raises(ValueError, match="lacks id"):
        vector.read_regions(spark, str(tmp_path / "l.shp"), ids=["XX"])
    (tmp_path / "l.prj").write_text('PROJCS["somewhere flat"]')
    with pytest.raises(ValueError, match="coordinates"):
        vector.read_regions(spark, str(tmp_path / "l.shp"))
    df.write.parquet(str(tmp_path / "l.parquet"))
    assert vector.read_regions(spark, str(tmp_path / "l.parquet"), ids=["ISO"], columns=[]).columns == ["ISO", "geometry"]
    df.createOrReplaceTempView("layer")
    assert vector.geometries(vector.read_regions(spark, table="layer"), ["ISO"], ["R1"]).count() == 1
    with pytest.raises(ValueError, match="path or"):
        vector.read_regions(spark)


def test_zarr(spark, tmp_path):
    x = np.arange(10.0).reshape(2, 5)
    (tmp_path / ".zarray").write_text(json.dumps({"dtype": "<f8", "shape": [2, 5], "chunks": [2, 3], "compressor": {"id": "zlib"}, "filters": None, "order": "C"}))
    (tmp_path / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["draw", "unit"]}))
    for j in range(2):
        part = np.zeros((2, 3))
        part[:, : len(x[0, 3 * j : 3 * j + 3])] = x[:, 3 * j : 3 * j + 3]
        (tmp_path / f"0.{j}").write_bytes(zlib.compress(part.tobytes()))
    assert sorted(tuple(r) for r in zarr.read_array(spark, str(tmp_path)).collect()) == [(i, j, float(x[i, j])) for i in range(2) for j in range(5)]


def small(spark):
    frame = spark.createDataFrame([("N", "p", 0.375, 3.0, "native"), ("S", "p", 0.625, 5.0, "native"), ("S", "q", 1.0, 4.0, "native")], "zone string, lot string, areawt double, area_raw double, area_method string")
    return WeightsArtifact(frame, OutputSchema(("zone",), ("area",), SourceUnits(("lot",)), "per_source"), "zones-3", "lots-8")


@pytest.mark.parametrize("fmt, single", [("both", False), ("csv", True), ("parquet", True)])
def test_artifact_files(spark, tmp_path, fmt, single):
    (tmp_path / "in.txt").write_text("x")
    out = artifacts.write_artifact(small(spark), str(tmp_path / "w"), fmt, single=single, inputs={"list": str(tmp_path / "in.txt")})
    info = json.loads((tmp_path / "w" / "weights.manifest.json").read_text())
    assert info["inputs"]["list"] == hashlib.sha256(b"x").hexdigest() and len(info["outputs"]) == len(out)
    if single:
        (file,) = [p for p in (tmp_path / "w").iterdir() if p.name in info["outputs"]]
        assert info["outputs"][file.name] == hashlib.sha256(file.read_bytes()).hexdigest()
    back = artifacts.load_artifact(spark, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in back.frame.select("zone", "lot", "areawt").collect()) == [("N", "p", 0.375), ("S", "p", 0.625), ("S", "q", 1.0)] and back.schema.normalization == "per_source"


@pytest.fixture
def published(spark, tmp_path):
    artifacts.write_artifact(small(spark), str(tmp_path / "site" / "files"), single=True)
    folder = tmp_path / "site" / "files"
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "site"))
    handler.log_message = lambda *a: None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    url = f"http://127.0.0.1:{server.server_port}"

    def publish(**change):
        files = []
        for f in ("weights.parquet", "weights.manifest.json"):
            data = (folder / f).read_bytes()
            files.append({"key": f, "size": len(data), "checksum": "md5:" + hashlib.md5(data).hexdigest(), "links": {"self": f"{url}/files/{f}"}} | change.get(f, {}))
        (tmp_path / "site" / "api" / "records").mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / "api" / "records" / "77").write_text(json.dumps({"files": files}))

    publish()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield url, publish, folder
    server.shutdown()


def test_fetch(spark, tmp_path, published, capsys):
    url, publish, folder = published
    cache = str(tmp_path / "cache")
    own = tmp_path / "r.toml"
    own.write_text(f'[artifacts.lots]\nrecord = "10.5281/zenodo.77"\nbase_url = "{url}"\n')
    get = lambda **k: registry.fetch_weights(spark, "lots", registry=str(own), cache=cache, **k)
    assert get().frame.count() == 3 and [c["record"] for c in registry.cached(cache)] == ["77"]
    publish(**{"weights.parquet": {"size": 1}})
    assert get().frame.count() == 3  # the cached copy is verified, not fetched
    with pytest.raises(registry.Incomplete):
        get(refresh=True)
    for change, error in (({"checksum": "md5:0"}, registry.Mismatch), ({"checksum": "crc:0"}, registry.FetchError), ({"key": "other"}, registry.FetchError)):
        publish(**{"weights.parquet": change})
        with pytest.raises(error):
            get(refresh=True)
    (tmp_path / "cache" / "record-77" / "lots" / "weights.parquet").write_bytes(b"no")
    with pytest.raises(registry.Mismatch, match="clear"):
        get()
    assert cli.main(["cache", "list", "--cache", cache]) == 0 and "record 77" in capsys.readouterr().out
    assert registry.clear_cache(cache) == 1 and registry.cached(cache) == []
    publish()
    info = json.loads((folder / "weights.manifest.json").read_text())
    (folder / "weights.manifest.json").write_text(json.dumps({k: v for k, v in info.items() if k != "outputs"}))
    publish()
    with pytest.raises(registry.FetchError, match="no checksum"):
        registry.fetch_weights(spark, "x", record="77", base_url=url, cache=cache)
    with pytest.raises(registry.UnknownArtifact):
        registry.fetch_weights(spark, "unheard", registry=str(own), cache=cache)
    own.write_text("[artifacts.bad]\n")
    with pytest.raises(registry.FetchError, match="no record"):
        registry.load_registry(str(own))
    with pytest.raises(registry.FetchError, match="no registry"):
        registry.load_registry(str(tmp_path / "none.toml"))


CONFIG = """
coverage = "pixel_centroid"
[project]
name = "two zones"
[regions]
path = "zones.parquet"
id_fields = ["zone"]
[grid]
mode = "generate"
resolution = 2.0
offset = "edge"
[output]
dir = "out"
[[weights]]
name = "area"
[[weights]]
name = "pop"
raster = "people.parquet"
resolution = 1.0
"""


def zones(spark, folder):
    rows = [("east", bytearray(rg.to_wkb([box(4, 0, 8, 2)]))), ("west", bytearray(rg.to_wkb([box(1, 0, 4, 2)])))]
    spark.createDataFrame(rows, "zone string, geometry binary").write.parquet(str(folder / "zones.parquet"))
    points = [(x + 0.5, y + 0.5, float(x + 10 * y)) for x in range(10) for y in range(4)]
    spark.createDataFrame(points, "longitude double, latitude double, population double").write.parquet(str(folder / "people.parquet"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    file = tmp_path / "run.toml"
    file.write_text(CONFIG)
    assert cli.main(["validate", str(file)]) == 1 and "missing" in capsys.readouterr().out
    zones(spark, tmp_path)
    assert cli.main(["validate", str(file)]) == 0
    assert cli.main(["run", str(file), "--legacy-csv"]) == 0
    got = {(r.zone, r.cell_ix): r for r in artifacts.load_artifact(spark, str(tmp_path / "out")).frame.collect()}
    assert set(got) == {("east", 92), ("east", 93), ("west", 90), ("west", 91)}
    assert got["west", 90].areawt == pytest.approx(1 / 3, rel=1e-4) and got["west", 91].popwt == pytest.approx((2 + 3 + 12 + 13) / (1 + 2 + 3 + 11 + 12 + 13))
    assert (tmp_path / "out" / "legacy.csv").exists()
    capsys.readouterr()
    assert cli.main(["regions", str(file), "%st"]) == 0 and "2 of 2" in capsys.readouterr().out
    assert cli.main(["estimate", str(file)]) == 0 and cli.main(["estimate", str(file), "--ceiling", "1"]) == 1
    file.write_text(CONFIG.replace('offset = "edge"', 'offset = "middle"'))
    assert cli.main(["run", str(file)]) == 2


@pytest.mark.parametrize("change, message", [(('name = "pop"', 'name = "area"'), "takes no raster"), (("[grid]", "[gird]"), "unknown"), (('mode = "generate"', 'mode = "prebuilt"'), "no resolution"), (("resolution = 2.0", "resolution = -2.0"), "positive"), (('path = "zones.parquet"', 'path = "a"\ntable = "b"'), "exactly one"), (('raster = "people.parquet"', ""), "exactly one"), (('coverage = "pixel_centroid"', 'normalization = "per_source"'), "per_destination"), (("[output]\ndir", "[output]\nfolder"), "unknown")])
def test_config_rules(tmp_path, change, message):
    file = tmp_path / "c.toml"
    file.write_text(CONFIG.replace(*change, 1))
    with pytest.raises(config.ConfigError, match=message):
        config.load(str(file))


def test_target_layers(spark, tmp_path):
    cells = [("A", i, j, f"name {i}", bytearray(rg.to_wkb([box(i, j, i + 1, j + 1)]))) for i in range(3) for j in range(2)] + [("Z", 9, 9, "gone", bytearray(rg.to_wkb([box(20, 20, 21, 21)])))]
    spark.createDataFrame(cells, "country string, col int, row int, label string, geometry binary").write.parquet(str(tmp_path / "src.parquet"))
    levels = [targets.Level("columns", ("country", "col"), ("label",)), targets.Level("country", ("country",))]
    account = targets.prepare(spark, str(tmp_path / "src.parquet"), levels, str(tmp_path / "t"), version="v7", drop="country = 'Z'")
    assert account["levels"]["columns"]["units"] == 3 and account["levels"]["country"]["union_area" if False else "dissolved_area"] == pytest.approx(6.0) and account["dropped"] == 1
    (one,) = spark.read.parquet(str(tmp_path / "t" / "country.parquet")).collect()
    assert len(rg.from_wkb(bytes(one.geometry))[0]) == 4
    for change, message in (({"drop": "col = 77"}, "matches no"), ({"repair": lambda d: d}, "record"), ({"repair": lambda d: d.limit(2), "repair_record": "x"}, "number of rows")):
        with pytest.raises(ValueError, match=message):
            targets.prepare(spark, str(tmp_path / "src.parquet"), levels, str(tmp_path / "u"), version="v7", **change)
