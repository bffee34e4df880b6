"""Shaped rings, holes, components, levels and depth regions against plain loops and samples of the plane."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bands as bd

RING = "array<struct<x: long, y: long>>"


def box(x0, y0, x1, y1, hole=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return ring[::-1] if hole else ring


def meet(a, b, c, d):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    on = lambda p, q, r: turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    t = [turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)]
    return (t[0] * t[1] < 0 and t[2] * t[3] < 0) or on(c, d, a) or on(c, d, b) or on(a, b, c) or on(a, b, d)


def crossing(rings):
    """The rings that meet another or themselves, by all pairs of edges."""
    edges = [(k, i, len(r) - 1, r[i], r[i + 1]) for k, r in rings.items() for i in range(len(r) - 1)]
    out = set()
    for n, (k, i, size, a, b) in enumerate(edges):
        for j_k, j, _, c, d in edges[n + 1 :]:
            near = k == j_k and (j - i == 1 or j - i == size - 1)
            if not near and meet(a, b, c, d):
                out |= {k, j_k}
    return out


def area2(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))


def settled(rings, tolerance, smooth):
    versions = {k: [[tuple(map(int, p)) for p in v] for v in bd.ring_versions(np.array(r, float), tolerance, smooth)] for k, r in rings.items()}
    at = {k: max(i for i, v in enumerate(vs) if i == 0 or area2(v) * area2(vs[0]) > 0) for k, vs in versions.items()}
    while True:
        met = crossing({k: versions[k][at[k]] for k in rings})
        if not any(at[k] for k in met):
            return {k: (at[k], k in met) for k in rings}
        for k in met:
            at[k] = max(at[k] - 1, 0)


def wavy(rng, cx, cy, radius, n, hole=False):
    angles = sorted(rng.uniform(0, 6.28) for _ in range(n))
    ring = [(int(cx + radius * rng.uniform(0.75, 1) * np.cos(a)), int(cy + radius * rng.uniform(0.75, 1) * np.sin(a))) for a in angles]
    ring = [p for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q]
    ring = [*ring, ring[0]]
    return ring[::-1] if hole else ring


def test_stages_equal_a_plain_loop_and_nothing_crosses(spark):
    rng = random.Random(3)
    groups = {}
    for g in range(5):
        groups[g] = {k: wavy(rng, rng.randrange(3) * 900, rng.randrange(3) * 900, rng.choice([120, 380, 400, 420]), rng.randint(8, 40), k % 2 == 1) for k in range(8)}
    groups[9] = {0: [(0, 0), (100, 100), (100, 0), (0, 100), (0, 0)], 1: box(300, 300, 400, 400)}  # one that crosses itself
    df = spark.createDataFrame([(g, k, r) for g, rings in groups.items() for k, r in rings.items()], f"group long, id long, ring {RING}").repartition(3)
    got = {}
    for r in bd.shaped_rings(df, 40.0, True, 150).collect():
        got.setdefault(r["group"], {})[r["id"]] = r
    kinds = set()
    for g, rings in groups.items():
        want = settled(rings, 40.0, True)
        assert {k: (r["stage"], r["crosses"]) for k, r in got[g].items()} == want
        kinds |= {r["kind"] for r in got[g].values()}
        free = {k: [(p["x"], p["y"]) for p in r["ring"]] for k, r in got[g].items()}
        assert crossing(free) == {k for k, r in got[g].items() if r["crosses"]}
    assert kinds == {"raw", "simplified", "smoothed"}


def test_simplified_rings_keep_far_vertices():
    square = np.array([(0, 0), (500, 3), (1000, 0), (1000, 1000), (0, 1000), (0, 0)], float)
    assert bd.simplified_ring(square, 5.0).tolist() == [[0, 0], [1000, 0], [1000, 1000], [0, 1000], [0, 0]]
    assert bd.simplified_ring(square, 1.0).tolist() == square.tolist()
    turned = bd.simplified_ring(square, 5.0, turned=True)
    assert turned[0].tolist() == turned[-1].tolist() == [1000, 1000] and len(turned) == 5
    sliver = np.array([(0, 0), (1000, 1), (2000, 0), (1000, -1), (0, 0)], float)
    assert bd.simplified_ring(sliver, 50.0).tolist() == [[0, 0], [2000, 0], [1000, -1], [0, 0]] and bd.simplified_ring(sliver, 50.0, True).tolist() == sliver.tolist()
    assert bd.smoothed_ring(np.array(box(0, 0, 4, 4), float))[:2].tolist() == [[1, 0], [3, 0]]


def test_simplified_rings_drop_what_has_no_area(spark):
    df = spark.createDataFrame([(1, box(0, 0, 90, 90)), (2, [(0, 0), (50, 0), (90, 0), (40, 0), (0, 0)])], f"id long, ring {RING}")
    assert [r["id"] for r in bd.simplified_rings(df, 10.0).collect()] == [1]


def test_holes_lie_in_the_smallest_outline(spark):
    rows = [(1, 0, box(0, 0, 100, 100)), (1, 1, box(10, 10, 90, 90, True)), (1, 2, box(20, 20, 80, 80)), (1, 3, box(30, 30, 40, 40, True)), (1, 4, box(50, 50, 53, 53, True)), (2, 0, box(0, 0, 9, 9)), (3, 5, box(200, 200, 210, 210, True))]
    df = spark.createDataFrame(rows, f"group long, id long, ring {RING}")
    assert {(r["group"], r["id"]): r["parent"] for r in bd.hole_parents(df, 7).collect()} == {(1, 1): 0, (1, 3): 2, (1, 4): 2, (3, 5): None}
    good = df.filter("group < 3")
    got = {(r["group"], r["id"]): (r["area"], len(r["rings"])) for r in bd.polygons_of(good, 7, least_hole=10.0).collect()}
    assert got == {(1, 0): (10000 - 6400, 2), (1, 2): (3600 - 100, 2), (2, 0): (81, 1)}
    with pytest.raises(Exception, match="no outline"):
        bd.polygons_of(df, 7).collect()
    sets = good.groupBy("group").agg(F.array_sort(F.collect_list("ring")).alias("rings"))
    assert sorted(r["area"] for r in bd.components_of(sets, "group", 7, least=100.0).collect()) == [3491.0, 3600.0]


def test_levels_pass_are_trimmed_or_break(spark):
    frame = spark.createDataFrame([(1, [box(0, 0, 4000, 4000)])], f"board long, rings array<{RING}>")
    levels = [(1, 1, [box(0, 0, 4002, 4000)]), (1, 2, [box(100, 100, 4003, 3900)]), (1, 3, [box(200, 200, 4008, 1200)]), (1, 4, [box(300, 300, 4100, 1100)]), (1, 5, [])]
    got = {r["level"]: r for r in bd.enforced(spark.createDataFrame(levels, f"board long, level long, rings array<{RING}>"), frame).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "passes", 2: "passes", 3: "trimmed", 4: "breach", 5: "passes"}
    assert got[3]["area"] == (4003 - 200) * 1000 and got[4]["area"] == 3800 * 800 and abs(got[3]["outside"] - 2 * 1000) < 20


def test_regions_hold_all_greater_depths(spark):
    rng = random.Random(5)
    rows = [(b, d, wavy(rng, rng.randrange(2000), rng.randrange(2000), 900, 12)) for b in range(3) for d in (5, 10, 15) for _ in range(2)]
    rows += [rows[0], (7, 5, box(0, 0, 100, 100)), (7, 5, box(20, 20, 60, 60)), (7, 10, box(30, 30, 50, 50)), (7, 10, box(30, 30, 50, 50))]
    got = {(r["body"], r["depth"]): r for r in bd.contour_regions(spark.createDataFrame(rows, f"body long, depth long, ring {RING}")).collect()}
    assert got[7, 10]["area"] == pytest.approx(400) and got[7, 5]["area"] == pytest.approx(10000 - 1600 + 400)
    x, y = (v.ravel() + 0.37 for v in np.meshgrid(np.arange(-900, 2900, 20.0), np.arange(-900, 2900, 20.0)))

    def odd(rings):
        inside = np.zeros(len(x), bool)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                if ay != by:
                    inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return inside

    for b in range(3):
        deeper = np.zeros(len(x), bool)
        for d in (15, 10, 5):
            deeper |= odd({tuple(r) for body, depth, r in rows if (body, depth) == (b, d)})
            assert (odd([[(p["x"], p["y"]) for p in ring] for ring in got[b, d]["rings"]]) != deeper).mean() < 0.003
        assert got[b, 5]["area"] >= got[b, 10]["area"] >= got[b, 15]["area"]
