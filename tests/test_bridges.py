"""Lines cut by areas and bridges, against plain loops that decide by middles and by union-find."""

import random
from math import hypot

from pyspark.sql import functions as F

from quern.operators import areas
from quern.operators import bridges as br
from quern.operators.graph import components

LINE = "array<struct<x: long, y: long>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
            odd ^= (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px
    return odd


def cut(line, rings):
    """(segment, t0, t1, inside), decided by the middle of each piece."""
    out = []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False), 1):
        ts = {0.0, 1.0}
        for ring in rings:
            for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
                dx, dy, ex, ey = bx - ax, by - ay, qx - px, qy - py
                den = dx * ey - dy * ex
                if den:
                    t, u = ((px - ax) * ey - (py - ay) * ex) / den, ((px - ax) * dy - (py - ay) * dx) / den
                    if 0 < t < 1 and 0 <= u <= 1:
                        ts.add(t)
        ts = sorted(ts)
        for t0, t1 in zip(ts, ts[1:], strict=False):
            if t1 - t0 >= 1e-12 and (ax, ay) != (bx, by):
                m = (t0 + t1) / 2
                out.append((i, t0, t1, inside(ax + (bx - ax) * m, ay + (by - ay) * m, rings)))
    return out


def stretches(line, rings):
    out = []
    for i, t0, t1, wet in cut(line, rings):
        place = lambda t, i=i: tuple(a + (b - a) * t for a, b in zip(line[i - 1], line[i], strict=True))
        if out and out[-1]["inside"] is wet:
            out[-1]["line"].append(place(t1))
        else:
            out.append({"inside": wet, "line": [place(t0), place(t1)]})
    return out


def plain_bridges(roads, rings, side):
    key = lambda p: (round(p[0] * 10), round(p[1] * 10))
    runs, dry = [], set()
    for name, line, tunnel in roads:
        parts = stretches(line, rings)
        for end in (0, -1):
            if parts and not parts[end]["inside"]:
                dry.add(key(parts[end]["line"][end]))
        for k, part in enumerate(parts):
            if part["inside"] and not tunnel:
                runs.append({"at": (name, k + 1), "line": part["line"], "ends": [(part["line"][0], k == 0), (part["line"][-1], k == len(parts) - 1)]})
    exits, nodes = [], []
    for r in runs:
        n, open_ends = 0, []
        for p, last in r["ends"]:
            edge = min(p) <= 0.001 or max(p) >= side - 0.001
            if not last or (not edge and key(p) in dry):
                n += 1
            elif not edge:
                open_ends.append(p)
        exits.append(n)
        nodes.append(open_ends)
    parent = list(range(len(runs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def tie(i, j):
        a, b = sorted((find(i), find(j)))
        parent[b] = a

    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
        return hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    for i in range(len(runs)):
        for j in range(len(runs)):
            for p in nodes[i]:
                if i != j and (any(key(p) == key(q) for q in nodes[j]) or any(distance(p, a, b) <= 10 for a, b in zip(runs[j]["line"], runs[j]["line"][1:], strict=False))):
                    tie(i, j)
    total = {}
    for i, n in enumerate(exits):
        total[find(i)] = total.get(find(i), 0) + n
    return {r["at"]: (exits[i], min(q["at"] for j, q in enumerate(runs) if find(j) == find(i)), total[find(i)] >= 2) for i, r in enumerate(runs)}


def tables(spark, boards):
    lines = [(b, name, line, tunnel, width) for b, (roads, _) in boards.items() for name, line, tunnel, width in roads]
    rings = [(b, ring) for b, (_, water) in boards.items() for ring in water]
    return spark.createDataFrame(lines, f"board long, id long, line {LINE}, tunnel boolean, width long").repartition(3), spark.createDataFrame(rings, f"board long, ring {LINE}").repartition(2)


def test_pieces_equal_the_middles_rule_on_random_boards(spark):
    rng = random.Random(6)
    point = lambda: (rng.randrange(20_000), rng.randrange(20_000))
    boards = {}
    for b in range(6):
        water = [[*(ring := [point() for _ in range(rng.randint(3, 9))]), ring[0]] for _ in range(3)]
        boards[b] = ([(k, [point() for _ in range(rng.randint(2, 12))], False, 1) for k in range(8)], water)
    lines, rings = tables(spark, boards)
    got = {}
    for r in areas.pieces(lines, rings, 3000).collect():
        got.setdefault((r["board"], r["id"]), []).append((r["i"], r["t0"], r["t1"], r["inside"]))
    for b, (roads, water) in boards.items():
        for name, line, *_ in roads:
            want, have = cut(line, water), sorted(got[b, name])
            assert [(i, wet) for i, _, _, wet in have] == [(i, wet) for i, _, _, wet in want]
            assert all(abs(x - y) < 1e-9 for h, w in zip(have, want, strict=True) for x, y in zip(h[1:3], w[1:3], strict=True))


def test_vertices_on_edges_and_corners_alternate(spark):
    water = [box(1000, 1000, 3000, 3000), box(1500, 1500, 2500, 2500)]
    through = {
        1: [(0, 0), (4000, 4000)],  # through corners
        2: [(0, 1000), (4000, 1000)],  # along an edge
        3: [(2000, 0), (2000, 1000), (2000, 4000)],  # a vertex on the shore
        4: [(1000, 1000), (3000, 3000)],  # from corner to corner
        5: [(0, 2000), (1000, 2000), (0, 2000)],  # touches and returns
        6: [(1200, 1200), (1200, 1200), (1300, 1200)],  # a segment of no length
        7: [(5000, 5000), (6000, 5000)],
    }
    lines, rings = tables(spark, {1: ([(k, line, False, 1) for k, line in through.items()], water)})
    found = {}
    for r in areas.runs(areas.pieces(lines, rings, 700)).orderBy("id", "run").collect():
        found.setdefault(r["id"], []).append((r["inside"], round(r["length"], 3), r["starts"], r["ends"]))
    assert [x[0] for x in found[1]] == [False, True, False, True, False] and abs(sum(x[1] for x in found[1]) - 4000 * 2**0.5) < 0.01
    for k in found:
        assert all(a[0] is not b[0] for a, b in zip(found[k], found[k][1:], strict=False)) and found[k][0][2] and found[k][-1][3]
    assert [x[:2] for x in found[3]] == [(False, 1000.0), (True, 500.0), (False, 1000.0), (True, 500.0), (False, 1000.0)]
    assert not any(x[0] for x in found[5]) and found[6] == [(True, 100.0, True, True)] and found[7] == [(False, 1000.0, True, True)]
    assert {r["id"] for r in areas.lines_in_areas(lines, rings, 700).collect()} >= {1, 3, 4, 6}


def test_bridges_piers_tunnels_and_shared_nodes(spark):
    strait = [box(0, 4000, 10_000, 6000)]
    roads = [
        (1, [(1000, 0), (1000, 10_000)], False, 1350),  # a bridge
        (2, [(2000, 0), (2000, 5000)], False, 400),  # a pier
        (3, [(3000, 0), (3000, 10_000)], True, 400),  # a tunnel
        (4, [(4000, 0), (4000, 5000)], False, 400), (5, [(4000, 5000), (4000, 10_000)], False, 3200),  # two ways that meet over water
        (6, [(5000, 0), (5000, 5200)], False, 390), (7, [(5004, 4800), (5004, 10_000)], False, 390),  # decoded by two tiles, a hair apart
        (8, [(6000, 0), (6000, 4000)], False, 390), (9, [(6000, 4000), (6000, 6000)], False, 390), (10, [(6000, 6000), (6000, 9000)], False, 390),  # a way of its own, from shore to shore
        (11, [(7000, 5000), (7100, 5000)], False, 390),  # afloat
        (12, [(5000, 4500), (10_000, 4500)], False, 390),  # leaves the board over water, from another road's deck
    ]
    more, rings = tables(spark, {3: (roads, strait), 4: ([(1, [(1, 1), (2, 2)], False, 1)], [])})
    got = br.crossings(more, rings, 10_000, 10_000, 900).collect()
    want = plain_bridges([r[:3] for r in roads], strait, 10_000)
    assert {(r["id"], r["run"]): (r["exits"], tuple(r["root"]), r["bridge"]) for r in got} == want
    crossed = {i for (i, _), (_, _, bridge) in want.items() if bridge}
    assert crossed == {1, 4, 5, 6, 7, 9, 12}
    assert [r["id"] for r in br.tunnels_over_water(more, rings, 900).collect()] == [3]
    report = br.bridge_report(br.crossings(more, rings, 10_000, 10_000, 900), more).collect()[0]
    assert (report["spans"], report["dead_ends"]) == (len([1 for v in want.values() if v[2]]), len({v[1] for v in want.values() if not v[2]}))
    assert report["thinnest"] == 390 and report["longest"] > 1900
    tab = br.bridge_tabs(br.crossings(more.filter("id = 1"), rings, 10_000, 10_000, 900), more).collect()[0]
    assert abs(tab["area"] - (2000 * 1350 + 3.14159265 * 675**2)) < 0.01 * tab["area"]


def test_bridges_equal_plain_loops_on_random_roads(spark):
    rng = random.Random(2)
    boards = {}
    for b in range(4):
        water = [box(x, y, x + rng.randrange(2000, 6000), y + rng.randrange(2000, 6000)) for x, y in ((rng.randrange(9000) + 3, rng.randrange(9000) + 7) for _ in range(4))]
        ends = [(rng.randrange(200, 15_000), rng.randrange(200, 15_000)) for _ in range(14)]
        boards[b] = ([(k, [rng.choice(ends), (rng.randrange(15_000), rng.randrange(15_000)), rng.choice(ends)], k % 6 == 0, 500) for k in range(20)], water)
    roads, rings = tables(spark, boards)
    got = {}
    for r in br.crossings(roads, rings, 15_200, 15_200, 1500).collect():
        got.setdefault(r["board"], {})[r["id"], r["run"]] = (r["exits"], tuple(r["root"]), r["bridge"])
    for b, (lines, water) in boards.items():
        assert got[b] == plain_bridges([x[:3] for x in lines], water, 15_200)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    lines, rings = tables(spark, {1: ([(1, [(0, 0), (9, 9)], False, 1)], [box(1, 1, 5, 5)])})
    assert areas.pieces(lines.filter(F.lit(False)), rings, 10).count() == 0
    assert [r["inside"] for r in areas.pieces(lines, rings.filter(F.lit(False)), 10).collect()] == [False]
    assert br.crossings(lines, rings.filter(F.lit(False)), 10, 10, 5).count() == 0
