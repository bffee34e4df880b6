"""What must not grow faster than the input: shuffles of lines cut in their groups, and work of rows."""

import random
from collections import Counter

import numpy as np

from quern.operators import areas
from quern.operators import bridges as br
from quern.operators import polygons as poly

LINE = "array<struct<x: long, y: long>>"


def boards(spark, n=3):
    rng = random.Random(4)
    line = lambda k: [(rng.randrange(9000), rng.randrange(9000)) for _ in range(k)]
    lines = [(b, 10 * b + k, line(9), k == 1, 400) for b in range(n) for k in range(4)]
    rings = [(b, (r := line(7)) + r[:1]) for b in range(n) for _ in range(2)]
    return spark.createDataFrame(lines, f"board long, id long, line {LINE}, tunnel boolean, width long"), spark.createDataFrame(rings, f"board long, ring {LINE}")


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_stretches_equal_runs_of_pieces_with_a_shuffle_of_lines_and_rings_alone(spark):
    lines, rings = boards(spark)
    want = {(r["board"], r["id"], r["run"]): r.asDict() for r in areas.runs(areas.pieces(lines, rings)).collect()}
    found = areas.stretches(lines, rings)
    got = {(r["board"], r["id"], r["run"]): r.asDict() for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for k, r in got.items():
        assert all(abs(r[c] - want[k][c]) < 1e-6 if c == "length" else r[c] == want[k][c] for c in want[k])
    assert shuffles(found) == 2


def test_crossings_shuffle_roads_and_water_alone(spark):
    roads, water = boards(spark)
    found = br.crossings(roads, water, 9000, 9000, lined=False)
    assert found.count() > 5 and shuffles(found) == 2 and "line" not in found.columns
    assert [r["spans"] >= 0 for r in br.bridge_report(found, roads).collect()]


def test_large_boards_are_cut_in_blocks(spark, monkeypatch):
    lines, rings = boards(spark)
    plain = sorted(areas.pieces(lines, rings).collect())
    monkeypatch.setattr(areas, "BLOCK", 2)
    assert sorted(areas.pieces(lines.coalesce(1), rings.coalesce(1)).collect()) == plain


def test_lines_without_a_group_meet_no_rings(spark):
    lines = spark.createDataFrame([(None, 1, [(0, 5), (10, 5)])], f"board long, id long, line {LINE}")
    rings = spark.createDataFrame([(None, [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)])], f"board long, ring {LINE}")
    assert [(r["inside"], r["length"]) for r in areas.stretches(lines, rings).collect()] == [(False, 10.0)]


def test_a_ring_is_decomposed_once_for_both_offsets(monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.integers(-20_000, 20_000, (24, 2)).astype(float)
    rings, calls, whole = [np.concatenate([p, p[:1]])], [], poly._decomposed
    want = [poly.offset(rings, d) for d in (500.0, -500.0)]
    monkeypatch.setattr(poly, "_decomposed", lambda *a, **k: calls.append(1) or whole(*a, **k))
    got = poly.offsets(rings, 500.0)
    assert len(calls) == 1 and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    for t in got:
        stacked = poly._stacked(t)
        assert len(stacked) < len(t) / 3 and abs(poly.area(stacked) - poly.area(t)) < 1e-3
        assert abs(sum(map(poly.signed_area, poly.rings_of(t))) - poly.area(t)) < 1e-4 * poly.area(t)


def test_sides_cancel_one_for_one():
    rng = random.Random(1)
    for _ in range(200):
        start = np.array([rng.randrange(3) for _ in range(rng.randrange(12))], np.int64)
        end = np.array([(x + rng.randint(1, 2)) % 3 for x in start], np.int64)
        stay, sides = poly._uncancelled(start, end), Counter(zip(start.tolist(), end.tolist(), strict=True))
        got = Counter(zip(start[stay].tolist(), end[stay].tolist(), strict=True))
        assert got == +Counter({k: n - sides[k[::-1]] for k, n in sides.items()})


def test_boxes_that_share_a_side_make_one_ring():
    box = lambda x0, y0, x1, y1: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)
    found = poly.rings_of(poly.union([[box(0, 0, 10, 30)], [box(10, 5, 20, 25)], [box(-5, 12, 0, 14)]]))
    assert len(found) == 1 and poly.signed_area(found[0]) == 510


def test_crop_places_come_from_arrays_and_keep_nulls(spark):
    from pyspark.sql import functions as F

    from quern.functions import frames as fr

    corner = lambda x, y: F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat"))
    df = spark.createDataFrame([(1, -1.0, 2.0), (2, None, 1.0), (3, 4.0, -2.5), (4, 1.5, 0.0)], "id long, lng double, lat double")
    df = df.withColumn("at", fr.corners(fr.crop(corner(-3.0, 4.0), corner(5.0, 4.5), corner(6.0, -3.5), corner(-2.5, -4.0))))
    found = fr.crop_project(df, "at", "lng", "lat", 300.0, 200.0)
    # Back through the bilinear map, a place is where it was.
    back = {r["id"]: r for r in found.withColumn("b", fr.crop_unproject(F.col("at"), F.col("mm.x"), F.col("mm.y"), 300.0, 200.0)).collect()}
    assert back[2]["mm"]["x"] is None
    assert all(abs(back[i]["b"]["lng"] - back[i]["lng"]) < 1e-6 and abs(back[i]["b"]["lat"] - back[i]["lat"]) < 1e-6 for i in (1, 3, 4))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_paths_are_moved_by_a_batch_of_rows_at_a_time(spark):
    from pyspark.sql import functions as F

    from quern.functions import settings as st

    rows = {
        "M0 0 L5 -1.25 Z": "M 10 -5 L 15 -6.25 Z", "m1 2 3 4 z": "m 11 -3 3 4 z", "A5 6 0 0 1 7 8": "A 5 6 0 0 1 17 3", "M0 0 H1 V2": "M 10 -5 H 11 V -3", "M-10 5": "M 0 0", "M.0004 1e2": "M 10 95", "M-10.0001 4.9999": "M 0 0",
        "M1.0005 1": "M 11.001 -4", "": "", "1 2": None, "M1": None, "M1 2 Z 3": None, "M L1 2": None, "M1e999 2": None, "M1e300 2 3 4 5": None,
    }
    df = spark.createDataFrame([*((k,) for k in rows), (None,)], "d string").select("d", st.moved_path(F.col("d"), F.lit(10.0), F.lit(-5.0)).alias("m"), st.moved_path(F.col("d"), F.lit(0.0), F.lit(0)).alias("same"))
    got = {r["d"]: (r["m"], r["same"]) for r in df.collect()}
    assert got == {k: (v, k) for k, v in rows.items()} | {None: (None, None)}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_interior_points_come_from_arrays(spark):
    from quern.operators import lines as ln

    close = lambda r: r + r[:1]
    rows = [
        (1, close([(0, 0), (10, 0), (10, 8), (0, 8)])), (2, close([(0, 0), (4, 9), (8, 0), (12, 9), (16, 0), (16, 10), (0, 10)])), (3, [(0, 0), (0, 4), (6, 4)]), (4, close([(0, 5), (9, 5)])), (5, []), (6, None),
        (7, close([(0, 0), (2, 0), (2, 6), (4, 6), (4, 0), (6, 0), (6, 10), (0, 10)])),
    ]
    found = ln.interior_points(spark.createDataFrame(rows, f"id long, ring {LINE}").coalesce(1))
    got = {r["id"]: (r["x"], r["y"], r["width"]) for r in found.collect()}
    assert got.keys() == {1, 2, 7} and got[1] == (5.0, 4.0, 10.0) and got[7] == (1.0, 5.0, 2.0)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_folded_from_arrow(spark):
    from quern.operators import features as op

    df = spark.createDataFrame([(1, 1, 2, "a", 50, 50), (1, 2, 1, "A ", 52, 50)], "board long, ix long, place long, name string, x long, y long")
    found = op.place_labels(df, 100, 100, 4, 8)
    assert {r["ix"]: r["reason"] for r in found.collect()} == {2: "placed", 1: "duplicate"}
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
