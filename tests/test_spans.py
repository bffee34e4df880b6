"""Least widths against every station and every edge."""

import random
from math import hypot

import pytest
from pyspark.sql import functions as F

from quern.operators import spans

RING = "array<struct<x: long, y: long>>"


def plain(line, rings, step):
    lengths = [hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(line, line[1:], strict=False)]
    total, walked, best = sum(lengths), 0.0, None
    margin = min(total * 0.1, 2000)
    for (a, b), size in zip(zip(line, line[1:], strict=False), lengths, strict=True):
        d = 0
        while d < size:
            if margin <= walked + d <= total - margin:
                x, y = a[0] + (b[0] - a[0]) * d / size, a[1] + (b[1] - a[1]) * d / size
                for ring in rings:
                    for p, q in zip(ring, ring[1:], strict=False):
                        dx, dy = q[0] - p[0], q[1] - p[1]
                        if dx or dy:
                            t = max(0, min(1, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy)))
                            away = hypot(x - p[0] - t * dx, y - p[1] - t * dy)
                            best = away if best is None else min(best, away)
            d += step
        walked += size
    return 2 * best if best is not None else 0.0


def test_widths_equal_all_pairs(spark):
    rng = random.Random(4)
    point = lambda size=30_000: (rng.randrange(size), rng.randrange(size))
    rings = {b: [[*(r := [point() for _ in range(5)]), r[0]] for _ in range(b + 1)] for b in range(3)}
    lines = {(b, k): [point() for _ in range(rng.randint(1, 6))] for b in range(5) for k in range(5)}
    lines[1, 9] = [(0, 0), (0, 0)]
    lines[2, 9] = [(500_000, 500_000), (530_000, 500_000)]  # far from every edge
    lines[3, 9] = [(-500, 0), (500, 0)]
    rings[3] = [[(-1000, 40), (1000, 40), (1000, -60), (-1000, -60), (-1000, 40)]]  # a strip, off its middle line
    df = spark.createDataFrame([(b, k, v) for (b, k), v in lines.items()], f"board long, id long, line {RING}").repartition(3)
    shores = spark.createDataFrame([(b, r) for b, rs in rings.items() for r in rs], f"board long, ring {RING}")
    got = {(r["board"], r["id"]): r["width"] for r in spans.least_widths(df, shores, 300, step=250).collect()}
    assert set(got) == set(lines)
    for k, line in lines.items():
        assert got[k] == pytest.approx(plain(line, rings.get(k[0], []), 250)), k
    assert got[3, 9] == 80 and got[4, 0] == 0 and got[1, 9] == 0
    assert {r["width"] for r in spans.least_widths(df, shores.filter(F.lit(False)), 300).collect()} == {0.0}


def test_an_edge_is_one_row_however_large_its_box_is(spark):
    far = 4_000_000_000
    lines = spark.createDataFrame([(0, 1, [(1000, 500), (3000, 500)])], f"board long, id long, line {RING}")
    shores = spark.createDataFrame([(0, [(0, 0), (far, 0), (far, far), (0, far), (0, 0)])], f"board long, ring {RING}")
    found = spans.least_widths(lines, shores, 1)
    assert [(r["id"], r["width"]) for r in found.collect()] == [(1, 1000.0)]
