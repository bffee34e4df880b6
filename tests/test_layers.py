"""Layers against samples of the plane."""

import numpy as np
import pytest

from quern.operators import layers


def even_odd(rings, x, y):
    inside = np.zeros(len(x), bool)
    for ring in rings:
        p = np.array([(v["x"], v["y"]) for v in ring], float)
        for a, b in zip(p[:-1], p[1:]):
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
    return inside


def test_engraved_roads_cover_what_is_near_them(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 3, [{"x": int(x), "y": int(y)} for x, y in rng.normal(0, 6000, (8, 2))], [400, 1500, 1500][i % 3]) for i in range(6)]
    df = spark.createDataFrame(rows, "board long, line array<struct<x: long, y: long>>, width long")
    got = {r["board"]: r for r in layers.road_engraving(df, least_area=0.0).collect()}
    assert set(got) == {0, 1}
    x, y = (v.ravel() for v in np.meshgrid(np.arange(-20000, 20000, 150.0), np.arange(-20000, 20000, 150.0)))
    for board, found in got.items():
        near = np.zeros(len(x), bool)
        for b, line, width in rows:
            p = np.array([(v["x"], v["y"]) for v in line], float)
            for a, c in zip(p[:-1], p[1:]):
                d = c - a
                t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / (d @ d), 0, 1)
                near |= (b == board) & (np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= width / 2)
        assert (even_odd(found["rings"], x, y) != near).mean() < 0.002
        assert found["area"] == pytest.approx(near.sum() * 150 * 150, rel=0.02) and found["widths"] == 2


def test_bands_of_a_cone_are_disks_in_each_other(spark):
    side, top = 40, 100_000
    cells = [(0, r, c, max(0, int(top - 5000 * np.hypot(r - 19.5, c - 19.5)))) for r in range(side) for c in range(side)]
    cells = [c for c in cells if (c[1], c[2]) != (3, 3)]
    grid = spark.createDataFrame(cells, "board long, r long, c long, v long")
    heights = spark.createDataFrame([(0, t) for t in (80_000, 20_000, 50_000)], "board long, threshold long")
    rows = sorted(layers.nested_bands(grid, heights, side).collect(), key=lambda r: r["level"])
    assert [(r["level"], r["threshold"]) for r in rows] == [(1, 20_000), (2, 50_000), (3, 80_000)]
    for r in rows:
        radius = (top - r["threshold"]) / 5000 * 1000
        assert r["area"] == pytest.approx(np.pi * radius**2, rel=0.03) and len(r["rings"]) == 1
        assert r["outside"] < 1000


def test_contours_close_around_the_board_and_absent_cells(spark):
    cells = [(0, r, c, 10) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    grid = spark.createDataFrame(cells, "board long, r long, c long, v long")
    rows = layers.nested_bands(grid, spark.createDataFrame([(0, 10)], "board long, threshold long"), 5).collect()
    assert len(rows) == 1 and len(rows[0]["rings"]) == 2
    assert layers.nested_bands(grid.limit(0), spark.createDataFrame([(0, 10)], "board long, threshold long"), 5).collect() == []
