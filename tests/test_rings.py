"""Rings as arrays: versions, clipping and levels against single rings, the slab kernel and samples of the plane; and what is shuffled for them."""

import random

import numpy as np
import pytest

from quern.operators import bands as bd
from quern.operators import layers
from quern.operators import polygons as poly
from quern.operators import rings as rg

RING = "array<struct<x: long, y: long>>"


def wavy(rng, cx, cy, radius, n):
    angles = sorted(rng.uniform(0, 6.28) for _ in range(n))
    ring = [(int(cx + radius * rng.uniform(0.75, 1) * np.cos(a)), int(cy + radius * rng.uniform(0.75, 1) * np.sin(a))) for a in angles]
    return np.array([*ring, ring[0]])


def box(x0, y0, x1, y1, hole=False):
    ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    return ring[::-1] if hole else ring


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_versions_of_all_rings_equal_those_of_each():
    rng = random.Random(2)
    rings = [wavy(rng, 0, 0, rng.choice([3, 60, 400]), rng.randint(2, 60)) for _ in range(60)] + [np.array([(0, 0), (9, 9), (0, 0)]), np.array([(5, 5), (5, 5), (80, 5), (5, 80), (5, 5)])]
    made = [rg.unpacked(m) for m in rg.versions(rg.packed(rings), 40.0, True, 4)]
    assert len(made) == 6
    for k, r in enumerate(rings):
        steps = [bd.simplified_ring(r.astype(float), t) for t in (5.0, 10.0, 20.0, 40.0)]
        for got, want in zip((m[k] for m in made), [r.astype(float), *steps, bd.smoothed_ring(steps[-1])], strict=True):
            assert got.tolist() == bd._whole(want).tolist()


def test_clipping_equals_the_slab_kernel():
    rng, done = random.Random(8), 0
    for _ in range(90):
        own = [wavy(rng, 500, 500, 450, 30), box(2000, 2000, 2900, 2900), box(2200, 2200, 2500, 2500, True), box(4000, 0, 4100, 100)]
        frame = [wavy(rng, 700, 500, 450, 30), box(2000, 1900, 2400, 2900), box(2100, 2300, 2300, 2500, True), box(2500, 2000, 2900, 2900)]
        if rng.random() < 0.3:
            frame = [*own[:3]]
        if len(rg.meeting(rg.packed(own), 100)) or len(rg.meeting(rg.packed(frame[:1]), 100)):
            continue
        done += 1
        area, outside, rings, edge = rg.clipped(rg.packed(own), rg.packed(frame), 100)
        parts = {k: poly.trapezoids([poly.edges_of(own), poly.edges_of(frame)], poly.OPERATIONS[k]) for k in ("intersection", "difference")}
        assert area == pytest.approx(poly.area(parts["intersection"]), abs=1) and outside == pytest.approx(poly.area(parts["difference"]), abs=1)
        assert sorted(map(poly.signed_area, rings)) == pytest.approx(sorted(map(poly.signed_area, poly.rings_of(parts["intersection"]))), abs=2)
        assert len(edge) == len(rings) and 0 <= edge.min() and edge.max() <= sum(len(r) - 1 for r in own)
    assert done > 40
    assert rg.clipped(rg.packed([]), rg.packed([box(0, 0, 9, 9)]), 5)[:3] == (0.0, 0.0, [])
    assert rg.clipped(rg.packed([box(0, 0, 9, 9)]), (np.zeros((0, 2), np.int64), np.array([0])), 5)[:3] == (0.0, 81.0, [])


def hills():
    """A wide hill with a wide pit that holds an islet, a narrow pit, and a narrow hill."""
    v = {(r, c): 10 for r in range(24) for c in range(24)}
    v |= {(r, c): 100 for r in range(3, 20) for c in range(3, 20)}
    v |= {(r, c): 10 for r in range(8, 15) for c in range(8, 15)}
    v |= {(11, 11): 100, (5, 5): 70, (22, 22): 52}
    return [(b, r, c, x) for b in (1, 2) for (r, c), x in v.items()]


def test_levels_have_outlines_with_their_holes_clipped_to_the_level_below(spark):
    grid = spark.createDataFrame(hills(), "board long, r long, c long, v long")
    heights = spark.createDataFrame([(b, t) for b in (1, 2) for t in (50, 80)], "board long, threshold long")
    rows = [r for r in bd.shaped_levels(grid, heights, 24, 100.0, True, 500).collect() if r["board"] == 1]
    low, high = ({r["id"]: r for r in rows if r["threshold"] == t} for t in (50, 80))
    size = {(r["threshold"], r["id"]): area2([(p["x"], p["y"]) for p in r["ring"]]) / 2 for r in rows}
    outlines = lambda level: [r for r in level.values() if r["parent"] is None]
    holes = lambda level: [r for r in level.values() if r["parent"] is not None]
    assert all((size[r["threshold"], r["id"]] > 0) == (r["parent"] is None) and not r["crosses"] for r in rows)
    # The narrow hill's tip is too small a piece at the lower level, and not there at the higher one.
    assert len(outlines(low)) == 3 and len(outlines(high)) == 2
    # The wide pit is a hole of the hill in either level; the islet in it is an outline of its own. The narrow pit is a small hole.
    for level, n in ((low, 1), (high, 2)):
        hill = max(outlines(level), key=lambda r: size[r["threshold"], r["id"]])
        assert len(holes(level)) == n and {h["parent"] for h in holes(level)} == {hill["id"]}
        open_ = [h for h in holes(level) if not h["filled"]]
        assert hill["pieces"] == 1 and len(open_) == 1
        whole = size[hill["threshold"], hill["id"]] + size[open_[0]["threshold"], open_[0]["id"]]
        assert hill["area"] == pytest.approx(whole, rel=0.001)
    assert sorted(r["pieces"] for r in outlines(low)) == [0, 1, 1]


def area2(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))


def test_levels_are_the_region_in_the_level_below(spark):
    rng = np.random.default_rng(4)
    rows = [(1, r, c, int(v)) for r in range(20) for c in range(20) for v in [rng.integers(0, 1000)]]
    grid, heights = spark.createDataFrame(rows, "board long, r long, c long, v long"), spark.createDataFrame([(1, t) for t in (300, 500, 700)], "board long, threshold long")
    got = bd.shaped_levels(grid, heights, 20, 150.0, True, 500, least_hole=0.0, least=0.0).collect()
    below = [box(-500, -500, 19500, 19500)]
    for t in (300, 500, 700):
        own = [np.array([(p["x"], p["y"]) for p in r["ring"]], float) for r in got if r["threshold"] == t]
        part = poly.trapezoids([poly.edges_of(own), poly.edges_of(below)], poly.OPERATIONS["intersection"])
        assert sum(r["area"] or 0 for r in got if r["threshold"] == t) == pytest.approx(poly.area(part), rel=1e-4)
        below = poly.rings_of(part)


def test_every_hole_of_a_contour_has_an_outline(spark):
    grid = spark.createDataFrame(hills(), "board long, r long, c long, v long")
    got = bd.level_hole_parents(grid, spark.createDataFrame([(1, 50), (2, 80)], "board long, threshold long"), 24).collect()
    assert sorted((r["board"], r["threshold"]) for r in got) == [(1, 50), (2, 80), (2, 80)] and all(r["parent"] is not None for r in got)


def test_boards_are_shaped_with_a_shuffle_of_samples_and_thresholds_alone(spark):
    grid = spark.createDataFrame(hills(), "board long, r long, c long, v long")
    heights = spark.createDataFrame([(1, 50), (1, 80), (2, 50)], "board long, threshold long")
    assert shuffles(bd.shaped_levels(grid, heights, 24, 100.0, True, 500)) == 2
    rings = spark.createDataFrame([(1, 0, box(0, 0, 90, 90).tolist()), (1, 1, box(10, 10, 40, 40, True).tolist())], f"group long, id long, ring {RING}")
    shaped = bd.shaped_rings(rings, 5.0, True, 50)
    assert shaped.count() == 2 and shuffles(shaped) == 1


def test_bands_are_nested_with_a_shuffle_of_samples_and_thresholds_alone(spark):
    grid = spark.createDataFrame(hills(), "board long, r long, c long, v long")
    found = layers.nested_bands(grid, spark.createDataFrame([(1, 50), (1, 80), (1, 500), (2, 50)], "board long, threshold long"), 24)
    assert {(r["board"], r["level"], r["threshold"], len(r["rings"])) for r in found.collect()} == {(1, 1, 50, 4), (1, 2, 80, 4), (2, 1, 50, 4)}
    assert shuffles(found) == 2


def test_the_query_tells_holes_from_outlines_and_what_is_left_of_them(spark):
    import os

    import __spark_entry__ as entry

    folder = os.environ.get("QUERN_SMOKE_DIR", "/root/testdata/sf0.001")
    rows = entry.queries()["shaped_bands"](spark, folder).collect()
    outlines = {(r["board"], r["threshold"], r["id"]) for r in rows if r["double_area"] > 0}
    holes = [r for r in rows if r["double_area"] < 0]
    assert outlines and holes and all((r["board"], r["threshold"], r["parent"]) in outlines and r["filled"] is not None for r in holes)
    assert all((r["pieces"] is None) == (r["double_area"] < 0) and (r["area"] or 0) >= 0 for r in rows)
    assert any(r["pieces"] for r in rows) and any(r["filled"] for r in holes)


def test_shapes_of_strokes_united_equal_the_slab_kernel():
    rng = np.random.default_rng(6)
    close = lambda p: np.concatenate([p, p[:1]])
    cases = [[rng.integers(-9000, 9000, (12, 2))] for _ in range(8)] + [[rng.integers(-1500, 1500, (9, 2)), close(rng.integers(-4000, 4000, (5, 2)))] for _ in range(8)]
    # Straight on, straight back, on itself, closed, repeated vertices, one place, and nothing.
    cases += [[np.array(p)] for p in ([(0, 0), (2000, 0), (5000, 0), (5000, 3000)], [(0, 0), (3000, 0), (1000, 0)], [(0, 0), (4000, 0), (4000, 0), (4000, 4000), (0, 4000), (0, 0)], [(7, 7)], [(0, 0), (90, 40), (200, 0)], [(0, 0), (3000, 100), (6000, 0), (9000, 800)])]
    cases += [[np.array([(0, 0), (3000, 3000)]), np.array([(0, 0), (3000, 3000)])], [np.array([(0, 0), (3000, 0)]), np.array([(3000, 0), (6000, 0)])], [np.zeros((0, 2))]]
    for lines in cases:
        for radius in (195.0, 675.0):
            shapes = poly.stroke_shapes(lines, radius, radius * 0.019)
            assert all(poly.signed_area(s) > 0 for s in shapes)
            area, rings = rg.united(rg.packed([np.floor(s * 1000 + 0.5).astype(np.int64) for s in shapes]), 1000)
            slabs = poly.stroke(lines, radius, radius * 0.019)
            assert area == pytest.approx(poly.area(slabs), rel=1e-5)
            large = lambda found: sorted(s for s in map(poly.signed_area, found) if abs(s) > 500)
            assert large(rings) == pytest.approx(large(poly.rings_of(slabs)), rel=1e-3, abs=300)


def test_joints_take_only_what_reaches_out_of_the_boxes():
    line = np.random.default_rng(3).integers(-9000, 9000, (32, 2))
    assert sum(len(s) - 1 for s in poly.stroke_shapes([line], 300.0, 5.7)) < 0.75 * len(poly.band([line], 300.0, 5.7))


def test_roads_of_a_board_are_shuffled_once(spark):
    rows = [(b, [(0, 0), (5000, 100 * k), (9000, 4000)], w) for b in (1, 2) for k, w in enumerate((400, 900, 400))]
    found = layers.road_engraving(spark.createDataFrame(rows, f"board long, line {RING}, width long"))
    assert [(r["board"], r["widths"]) for r in sorted(found.collect())] == [(1, 2), (2, 2)] and shuffles(found) == 1
