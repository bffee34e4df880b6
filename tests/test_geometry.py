"""Exact expectations of the geometry, grid and scalar functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import geometry as geo
from quern.functions import scalars as sc
from quern.operators import grid as g
from quern.operators import lines as op

XY = "array<struct<x: long, y: long>>"


def line_df(spark, lines):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(lines)], f"id long, line {XY}")


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_ring_measures(spark):
    df = line_df(spark, [SQUARE])
    assert one(df, geo.double_area(F.col("line"))) == 200
    assert one(df, geo.length(F.col("line"))) == 40.0
    assert one(df, geo.point_in_ring(F.lit(5), F.lit(5), F.col("line"))) is True
    assert one(df, geo.point_in_ring(F.lit(15), F.lit(5), F.col("line"))) is False
    assert len(one(df, geo.chaikin_ring(F.col("line")))) == 9


def test_clean_ring(spark):
    df = line_df(spark, [[(0, 0), (0, 0), (5, 0), (5, 5), (5, 5), (0, 0), (0, 0)], [(0, 0), (1, 1), (0, 0)]])
    got = [r["v"] and [tuple(p) for p in r["v"]] for r in df.orderBy("id").select(geo.clean_ring(F.col("line")).alias("v")).collect()]
    assert got == [[(0, 0), (5, 0), (5, 5), (0, 0)], None]


def test_keys_ignore_direction_and_start(spark):
    turned = SQUARE[2:4] + SQUARE[0:3]
    df = line_df(spark, [SQUARE, turned, SQUARE[::-1], SQUARE[:4]])
    assert df.select(geo.ring_key(F.col("line"))).distinct().count() == 1
    assert line_df(spark, [[(0, 1), (5, 2)], [(5, 2), (0, 1)]]).select(geo.line_key(F.col("line"))).distinct().count() == 1


def test_clip_gives_runs_that_leave_and_come_back(spark):
    df = line_df(spark, [[(-20, 0), (20, 0), (20, 5), (-20, 5)], [(100, 100), (200, 200)], [(0, 0), (1, 1), (2, 0)]])
    got = {(r["id"], r["run"]): (r["first"], r["last"], r["t0"], r["t1"], len(r["line"])) for r in op.clip(df, lambda s: geo.rect_interval(s, -10.0, -10.0, 10.0, 10.0)).collect()}
    assert got == {(0, 1): (1, 1, 0.25, 0.75, 2), (0, 2): (3, 3, 0.25, 0.75, 2), (2, 1): (1, 2, 0.0, 1.0, 3)}


def test_simplify_keeps_what_deviates(spark):
    got = op.simplify(line_df(spark, [[(0, 0), (5, 1), (10, 0), (10, 10)]]), 2.0).first()["line"]
    assert [tuple(p) for p in got] == [(0, 0), (10, 0), (10, 10)]


def test_quantile_bands(spark):
    grid = spark.createDataFrame([(0, 0, i, i + 1) for i in range(100)], "board long, r long, c long, v long")
    got = {r["target_pct"]: (r["cells"], r["threshold"]) for r in g.quantile_bands(grid, (0.5, 0.25, 0.12, 0.01, 0.999, 1.0, 0.0)).collect()}
    for p in (0.5, 0.25, 0.12, 0.01, 0.999):
        assert got[p * 100][0] == math.ceil(100 * p)
    assert got[100.0] == (100, 1) and got[0.0] == (1, 100)


def test_contour_elevations(spark):
    df = spark.createDataFrame([(0, 90), (5, 5)], "low long, high long")
    assert [r["elevation"] for r in g.contour_elevations(df, 8).collect()] == [10, 20, 30, 40, 50, 60, 70, 80]
    assert [r["elevation"] for r in g.contour_elevations(spark.createDataFrame([(-30, 30)], "low long, high long"), 5).collect()] == [-20, -10, 0, 10, 20]


def test_octile_distance_and_bodies(spark):
    # A 5 x 5 board with one absent cell in the middle.
    grid = spark.createDataFrame([(0, r, c, 1) for r in range(5) for c in range(5) if (r, c) != (2, 2)], "board long, r long, c long, v long")
    got = {(r["r"], r["c"]): (r["straight"], r["diagonal"]) for r in g.octile_distance(grid, 5).collect()}
    assert got[2, 1] == (1, 0) and got[1, 1] == (0, 1) and got[0, 0] == (1, 0)
    assert [tuple(r) for r in g.water_bodies(grid, 5).collect()] == [(0, 0, 1, 12)]


def test_smoothing_keeps_a_constant(spark):
    grid = spark.createDataFrame([(0, r, c, 7) for r in range(6) for c in range(6)], "board long, r long, c long, v long")
    got = g.smooth(grid, (1, 4, 6, 4, 1), 6).collect()
    assert len(got) == 36 and {r["total"] for r in got} == {7 * 256}


def hash_model(x, y, seed):
    m = (1 << 32) - 1
    h = ((seed ^ sc.SEED_SALT) & m) * sc.MIX_A & m
    for v, k, mul, shift in ((x, sc.LATTICE_X, sc.MIX_B, 15), (y, sc.LATTICE_Y, sc.MIX_C, 13)):
        h ^= (v & m) * k & m
        h ^= h >> shift
        h = h * mul & m
    h ^= h >> 16
    h = h * sc.MIX_A & m
    return h ^ h >> 14


def test_noise_hash_equals_the_model(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-(2**31), 2**31 - 1), rng.randint(-(2**31), 2**31 - 1), rng.randint(0, 2**32 - 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x long, y long, s long")
    got = df.select("x", "y", "s", sc.noise_hash(F.col("x"), F.col("y"), F.col("s")).alias("h")).collect()
    assert all(r["h"] == hash_model(r["x"], r["y"], r["s"]) for r in got)


@pytest.mark.parametrize(("value", "want"), [("Lake Érie  (North)!", "lake-erie-north"), ("", "map"), (None, "map"), ("---", "map")])
def test_slug(spark, value, want):
    df = spark.createDataFrame([(value,)], "s string")
    assert one(df, sc.slug(F.col("s"), "map")) == want


def test_tile_paths(spark):
    df = spark.createDataFrame([("/api/terrain/3/7/7.png",), ("/api/terrain/3/8/7.png",), ("/api/terrain/16/0/0.png",), ("/x/3/1/1.png",)], "p string")
    got = [r["v"] and tuple(r["v"]) for r in df.select(sc.tile_of_path(F.col("p")).alias("v")).collect()]
    assert got == [(3, 7, 7), None, None, None]


def test_paths_move_by_their_commands(spark):
    from quern.functions import settings as st

    cases = {
        "M0 0L10 0 10 10Z": "M 5 -2 L 15 -2 15 8 Z", "M 1,1 C 1 2 3 4 5 6 7 8 9 10 11 12": "M 6 -1 C 6 0 8 2 10 4 12 6 14 8 16 10", "H3 V4 h1 v1": "H 8 V 2 h 1 v 1",
        "m1 1 2 2 l3 3": "m 6 -1 2 2 l 3 3", "M0 0 m1 1": "M 5 -2 m 1 1", "A1 2 30 0 1 4 5": "A 1 2 30 0 1 9 3", "a1 2 30 0 1 4 5": "a 1 2 30 0 1 4 5", "M.5-.25": "M 5.5 -2.25",
        "M1e1 1.00049": "M 15 -1", "M-5 2": "M 0 0", "": "", "1 2": None, "M1": None, "M1 2 3": None, "C1 2 3 4": None, "M1 2 Z 3": None, "L": None, "M1e999 0": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r["d"]: r["m"] for r in df.select("d", st.moved_path(F.col("d"), F.lit(5.0), F.lit(-2.0)).alias("m")).collect()}
    assert got == cases
    assert df.filter("d = 'M1'").select(st.moved_path(F.col("d"), F.lit(0.0), F.lit(0.0)).alias("m")).first()["m"] == "M1"
