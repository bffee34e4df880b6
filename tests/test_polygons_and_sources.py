"""Polygon kernels against exact areas, and readers and writers against what they were given."""

import io
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import polygons as poly
from quern.sources import geo, png, svg


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


@pytest.mark.parametrize(("name", "want"), [("union", 175.0), ("intersection", 25.0), ("difference", 75.0), ("xor", 150.0)])
def test_booleans_of_squares(name, want):
    t = poly.trapezoids([poly.edges_of([square(0, 0, 10)]), poly.edges_of([square(5, 5, 10)])], poly.OPERATIONS[name])
    assert poly.area(t) == pytest.approx(want)


def test_booleans_of_stars_add_up():
    a, b = poly.edges_of([poly.star(1000, 7)]), poly.edges_of([[(x + 300, y - 200) for x, y in poly.star(900, 5)]])
    area = {k: poly.area(poly.trapezoids([a, b], f)) for k, f in poly.OPERATIONS.items()}
    own = [poly.area(poly.trapezoids([x], lambda i: i)) for x in (a, b)]
    assert area["union"] + area["intersection"] == pytest.approx(sum(own))
    assert area["xor"] == pytest.approx(area["union"] - area["intersection"])
    assert area["difference"] == pytest.approx(own[0] - area["intersection"])


def test_holes_and_offsets():
    ring = [square(0, 0, 100), square(25, 25, 50)]
    assert poly.area(poly.trapezoids([poly.edges_of(ring)], lambda a: a)) == pytest.approx(7500)
    grown = poly.area(poly.offset([square(0, 0, 100)], 10, 0.01))
    assert grown == pytest.approx(10000 + 4000 + math.pi * 100, rel=1e-3)
    assert poly.area(poly.offset([square(0, 0, 100)], -10, 0.01)) == pytest.approx(6400, rel=1e-3)
    assert poly.area(poly.offset([square(0, 0, 10)], -20)) == 0


def outline(rings):
    return sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in rings)


@pytest.mark.parametrize("name", list(poly.OPERATIONS))
def test_rings_enclose_what_the_trapezoids_cover(name):
    rng = np.random.default_rng(len(name))
    for _ in range(25):
        a, b = ([np.vstack([p, p[:1]])] for p in (np.round(rng.uniform(-15000, 15000, (n, 2))) for n in rng.integers(3, 30, 2)))
        t = poly.trapezoids([poly.edges_of(a), poly.edges_of(b)], poly.OPERATIONS[name])
        rings = poly.rings_of(t)
        assert all((r[0] == r[-1]).all() and len(r) > 3 for r in rings)
        # Vertices are rounded to whole micrometres.
        slack = outline(rings) + 1
        assert abs(sum(map(poly.signed_area, rings)) - poly.area(t)) < slack
        assert abs(poly.area(poly.trapezoids([poly.edges_of(rings)], lambda i: i)) - poly.area(t)) < 2 * slack


def test_rings_of_holes_and_corners_that_touch():
    rings = poly.rings_of(poly.trapezoids([poly.edges_of([square(0, 0, 1000), square(250, 250, 500)])], lambda i: i))
    assert sorted(map(poly.signed_area, rings)) == [-250_000, 1_000_000] and {len(r) for r in rings} == {5}
    rings = poly.rings_of(poly.union([[square(0, 0, 1000)], [square(1000, 1000, 500)], [square(200, 200, 100)]]))
    assert sorted(map(poly.signed_area, rings)) == [250_000, 1_000_000]
    assert poly.rings_of(poly.union([])) == []


def test_results_chain_and_are_written(spark):
    row = lambda *rings: [[{"x": x, "y": y} for x, y in r] for r in rings]
    df = spark.createDataFrame([(1, row(square(0, 0, 10_000)), row(square(5000, 5000, 10_000))), (2, row(square(0, 0, 10_000)), row()), (3, None, row(square(0, 0, 10_000)))], f"id long, a {poly.RINGS}, b {poly.RINGS}")
    less = poly.boolean(df, "a", "b", "difference", "c")
    back = poly.boolean(less, "c", "b", "union", "d")
    got = {r["id"]: r["area"] for r in back.collect()}
    assert got == {1: pytest.approx(175e6), 2: pytest.approx(100e6), 3: pytest.approx(100e6)}
    path = back.filter("id = 1").select(svg.path(F.array("d")).alias("p")).first()["p"]
    assert path.count("M") == 1 and path.count("L") == 7 and path.endswith("Z") and "15 15" in path


def test_strokes_of_lines(spark):
    lines = [[{"x": 0, "y": 0}, {"x": 5000, "y": 0}, {"x": 5000, "y": 5000}]]
    df = spark.createDataFrame([(1, lines, 500.0), (2, [], 500.0)], f"id long, lines {poly.RINGS}, r double")
    got = {r["id"]: (r["area"], len(r["rings"])) for r in poly.stroked(df, "lines", "r", 0.01).collect()}
    assert got[2] == (0.0, 0) and got[1][1] == 1
    assert got[1][0] == pytest.approx(2 * 5000 * 1000 + math.pi * 250_000 - (250_000 - math.pi * 62_500), rel=2e-3)


def test_islands(spark):
    rings = [[{"x": x, "y": y} for x, y in square(0, 0, n)] for n in (100, 3, 20)]
    df = spark.createDataFrame([(1, rings)], f"id long, rings {poly.RINGS}")
    assert {r["island"]: r["keeps"] for r in poly.islands(df, 50).collect()} == {0: True, 1: False, 2: True}


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image, filters):
    h, w, n = image.shape
    raw, above = b"", np.zeros(w * n, np.int64)
    for y in range(h):
        line = image[y].reshape(-1).astype(np.int64)
        left = np.concatenate([np.zeros(n, np.int64), line[:-n]])
        corner = np.concatenate([np.zeros(n, np.int64), above[:-n]])
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = {0: 0, 1: left, 2: above, 3: (left + above) >> 1, 4: paeth}[filters[y % len(filters)]]
        raw += bytes([filters[y % len(filters)]]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    image = np.random.default_rng(channels).integers(0, 256, (9, 7, channels), dtype=np.uint8)
    got = png.pixels(encode(image, [0, 1, 2, 3, 4]))
    assert (got == (image[:, :, :3] if channels >= 3 else np.repeat(image[:, :, :1], 3, axis=2))).all()


def test_mosaic(spark):
    tile = np.zeros((4, 4, 3), np.uint8)
    tile[..., 0], tile[..., 1] = 128, np.arange(16).reshape(4, 4)
    tiles = spark.createDataFrame([(1, x, 0, bytearray(encode(tile, [0]))) for x in (0, 1)], "z int, x int, y int, content binary")
    plan = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 0, 0, 0, 1)], "z int, x int, y int, row int, column int")
    got = {(r["r"], r["c"]): r["elevation"] for r in png.mosaic(plan, tiles, 4).collect()}
    assert len(got) == 32 and got[1, 2] == 6.0 and got[1, 6] == 6.0
    with pytest.raises(Exception, match="missing"):
        png.mosaic(plan, tiles.filter("x = 0"), 4).collect()


def test_depth_regions(spark):
    ring = [[[0, 0], [1, 0], [0, 1], [0, 0]]]
    feature = lambda p, g: {"type": "Feature", "properties": p, "geometry": g}
    doc = {"type": "FeatureCollection", "features": [feature({"depth": 10, "unit": "ft"}, {"type": "Polygon", "coordinates": ring}), feature({"depth_value": 3.048, "depth_unit": "m"}, {"type": "MultiPolygon", "coordinates": [ring, ring]})]}
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    got = geo.depth_regions(df).collect()
    assert [(r["depth_m"], len(r["polygons"]), r["regions"]) for r in got] == [(3.048, 3, 2)]
    bad = json.dumps(feature({"depth": 1, "unit": "fathoms"}, {"type": "Polygon", "coordinates": ring}))
    with pytest.raises(Exception, match="unit"):
        geo.depth_regions(spark.createDataFrame([(bad,)], "json string")).collect()


def test_gpx(spark):
    pt = lambda tag, a, b: f'<{tag} lat="{a}" lon="{b}"/>'
    docs = [
        (1, f"<gpx><trk><trkseg>{pt('trkpt', 1, 2)}{pt('trkpt', 3, 4)}</trkseg><trkseg>{pt('trkpt', 5, 6)}</trkseg></trk><rte>{pt('rtept', 0, 0)}{pt('rtept', 1, 1)}</rte></gpx>"),
        (2, f"<gpx><rte>{pt('rtept', 0, 0)}{pt('rtept', 1, 1)}</rte></gpx>"),
        (3, f"<gpx>{pt('wpt', 0, 0)}{pt('wpt', 1, 1)}{pt('wpt', 2, 2)}</gpx>"),
    ]
    got = {r["id"]: (r["source"], [tuple(p) for p in r["points"]]) for r in geo.gpx_segments(spark.createDataFrame(docs, "id long, xml string")).collect()}
    assert got == {1: ("track", [(2.0, 1.0), (4.0, 3.0)]), 2: ("route", [(0.0, 0.0), (1.0, 1.0)]), 3: ("waypoints", [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])}
    with pytest.raises(Exception, match="out of range"):
        geo.gpx_segments(spark.createDataFrame([(4, f"<gpx><rte>{pt('rtept', 91, 0)}{pt('rtept', 1, 1)}</rte></gpx>")], "id long, xml string")).collect()


def test_geocoders(spark):
    a = json.dumps([{"place_id": 7, "display_name": "X", "lat": "45.5", "lon": "-88", "boundingbox": ["1", "2", "3", "4"]}, {"place_id": 8, "lat": "x", "lon": "1"}])
    b = json.dumps({"features": [{"geometry": {"coordinates": [1.5, 2.5]}, "properties": {"osm_id": 1, "name": "A", "city": "A", "country": "C"}}]})
    c = json.dumps({"result": {"addressMatches": [{"matchedAddress": "M", "coordinates": {"x": -1.0, "y": 2.0}, "tigerLine": {"tigerLineId": "t"}}]}})
    frame = lambda x: spark.createDataFrame([(1, x)], "q long, json string")
    assert [tuple(r) for r in geo.nominatim(frame(a)).select("id", "label", "lng", "lat", "box").collect()] == [("7", "X", -88.0, 45.5, [3.0, 1.0, 4.0, 2.0])]
    assert [tuple(r) for r in geo.photon(frame(b)).select("id", "label", "lng", "lat").collect()] == [("1", "A, C", 1.5, 2.5)]
    assert [tuple(r) for r in geo.census(frame(c)).select("id", "label", "lng", "lat").collect()] == [("t", "M", -1.0, 2.0)]


def test_captured_features(spark):
    rows = [(0, "water", "Polygon", {}, ["w"]), (1, "water", "Point", {}, ["p"]), (2, "transportation", "MultiLineString", {"class": "path"}, ["a", "b"]), (3, "transportation", "LineString", {}, ["c"]), (4, "place", "Point", {"name": " N ", "rank": "3"}, ["d"]), (5, "landuse", "Polygon", {}, ["e"])]
    df = spark.createDataFrame(rows, "ix long, source_layer string, geom_type string, properties map<string, string>, parts array<string>")
    got = {(r["kind"], r["ix"], r["part"], r["class"], r["name"], r["rank"]) for r in geo.captured_features(df).collect()}
    assert got == {("water", 0, 0, None, None, 99), ("road", 2, 0, "path", None, 99), ("road", 2, 1, "path", None, 99), ("label", 4, 0, None, "N", 3)}


def test_settings(spark):
    df = spark.createDataFrame([(1, '{"version": 1, "size": 5}'), (2, '{"version": 2, "size": 5}'), (3, "not json")], "id long, json string")
    got = geo.project_settings(df, "version int, size int, name string", {"version": 1, "size": 9, "name": "n"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 5, "n"), (2, 1, 9, "n"), (3, 1, 9, "n")]


def test_svg_and_zip(spark, tmp_path):
    df = spark.createDataFrame([(0,), (-5,), (1500,), (-12345,), (100,)], "v long")
    assert [r["m"] for r in df.select(svg.millimetres(F.col("v")).alias("m")).collect()] == ["0", "-0.005", "1.5", "-12.345", "0.1"]
    shapes = spark.createDataFrame([(1, "cut", 2, "M2"), (1, "cut", 1, "M1"), (1, "other", 1, "M3")], "board long, group string, ix long, d string").withColumns({"w": F.lit(1000), "h": F.lit(2000)})
    drawn = svg.documents(shapes, ["cut", "score"], "w", "h", svg.metadata_xml({"note": F.lit("a<b")}))
    text = drawn.first()["svg"]
    assert text == '<svg xmlns="http://www.w3.org/2000/svg" width="1mm" height="2mm" viewBox="0 0 1 2"><metadata><note>a&lt;b</note></metadata><g id="other"><path d="M3"/></g><g id="cut"><path d="M1"/><path d="M2"/></g><g id="score"></g></svg>'
    svg.write(drawn, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out/board=1").first()[0] == text
    content = svg.zipped(drawn.select("board", F.lit("a.svg").alias("name"), "svg")).first()["content"]
    assert zipfile.ZipFile(io.BytesIO(content)).read("a.svg").decode() == text


def test_a_png_that_is_cut_short_is_refused():
    from quern.plans.tiles import encoded

    image = np.arange(6 * 4 * 3).reshape(6, 4, 3) * 7 % 256
    whole = encoded(image)
    assert (png.pixels(whole) == image).all()
    for bad in (whole[:-12], whole[:8], b"GIF89a" + whole, png.SIGNATURE + whole[-12:]):
        with pytest.raises(ValueError, match="PNG"):
            png.pixels(bad)
