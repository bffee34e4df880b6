"""Surveys and bodies of water against samples of the plane."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import surveys as sv
from quern.operators.polygons import star

RING = "array<struct<x: long, y: long>>"


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def moved(radius, points, cx, cy):
    return [(int(x) + cx, int(y) + cy) for x, y in star(radius, points)]


def test_matches_by_point_and_by_half_of_the_smaller(spark):
    rng = random.Random(1)
    waters = {b: [moved(3000, 7, rng.randrange(12_000), rng.randrange(12_000))] for b in range(6)}
    waters[0].append([(p[0] // 4 + 3 * waters[0][0][0][0] // 4 - 1200, p[1] // 4 + 3 * waters[0][0][0][1] // 4) for p in waters[0][0]])
    outlines = {k: [moved(rng.choice([900, 2500, 3300]), 9, rng.randrange(12_000), rng.randrange(12_000)), moved(300, 5, 0, 0)] for k in range(40)}
    points = {k: (rng.randrange(12_000), rng.randrange(12_000)) for k in range(0, 40, 4)}
    x, y = (v.ravel() + 0.41 for v in np.meshgrid(np.arange(-4000, 16_000, 40.0), np.arange(-4000, 16_000, 40.0)))
    covered = {b: inside(r, x, y) for b, r in waters.items()}
    p = spark.createDataFrame([(k, *v) for k, v in points.items()], "key long, x long, y long")
    o = spark.createDataFrame([(k, r) for k, rings in outlines.items() for r in rings], f"key long, ring {RING}")
    w = spark.createDataFrame(list(waters.items()), f"body long, rings array<{RING}>")
    got = {(r["key"], r["body"]): r for r in sv.matches(p, o, w, 2000).collect()}
    for k, (outer, _) in outlines.items():
        own = inside([outer], x, y)
        for b in waters:
            found = got.get((k, b))
            if k in points and inside(waters[b], np.array([points[k][0] + 1e-7]), np.array([points[k][1] + 1e-7]))[0]:
                assert found["how"] == "point" and found["shared"] is None
                continue
            common, smaller = (own & covered[b]).sum() * 1600, min(own.sum(), covered[b].sum()) * 1600
            if abs(common - 0.5 * smaller) > 0.02 * smaller:
                assert (found is not None) == (common > 0.5 * smaller)
            if found:
                assert found["how"] == "overlap" and found["shared"] == pytest.approx(common, rel=0.03)
    assert {r["how"] for r in got.values()} == {"point", "overlap"}


def test_depths_come_from_all_matched_surveys(spark):
    square = lambda d, x=0: [(x + d, d), (x + 1000 - d, d), (x + 1000 - d, 1000 - d), (x + d, 1000 - d), (x + d, d)]
    contours = spark.createDataFrame([(1, 0, square(0)), (1, 5, square(100)), (1, 10, square(300)), (2, 5, square(100, 2000)), (2, 8, square(499, 2000)), (3, 5, square(0, 9000))], f"key long, depth long, ring {RING}")
    waters = spark.createDataFrame([(7, [[(-100, -100), (3100, -100), (3100, 1100), (-100, 1100), (-100, -100)]])], f"body long, rings array<{RING}>")
    points = spark.createDataFrame([(2, 2500, 500)], "key long, x long, y long")
    found = sv.matches(points, contours.select("key", "ring"), waters, 500)
    assert {(r["key"], r["how"]) for r in found.collect()} == {(1, "overlap"), (2, "point")}
    got = {r["depth"]: r["area"] for r in sv.measured_depths(found, contours, least_area=100.0).collect()}
    assert got == {5: pytest.approx(2 * 800 * 800), 10: pytest.approx(400 * 400)}
    assert sv.matches(points.filter(F.lit(False)), contours.select("key", "ring").filter(F.lit(False)), waters, 500).count() == 0


def test_points_are_held_against_waters_near_them_only(spark):
    from quern.operators import surveys

    box = lambda x: [[(x, 0), (x + 900, 0), (x + 900, 900), (x, 900), (x, 0)]]
    n, ring = 40, "array<struct<x: long, y: long>>"
    waters = spark.createDataFrame([(k, box(k * 2000)) for k in range(n)], f"body long, rings array<{ring}>")
    points = spark.createDataFrame([(k, k * 2000 + 100, 100) for k in range(n)], "key long, x long, y long")
    met = []
    hits, surveys._ray_hits = surveys._ray_hits, lambda at, edges, cell: (met.append(at.count()), hits(at, edges, cell))[1]
    try:
        found = surveys.matches(points, spark.createDataFrame([], f"key long, ring {ring}"), waters, 1000).collect()
    finally:
        surveys._ray_hits = hits
    assert sorted((r["key"], r["body"], r["how"]) for r in found) == [(k, k, "point") for k in range(n)]
    assert met == [n]
