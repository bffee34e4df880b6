"""Label placement against a plain loop over all boxes."""

import random

from pyspark.sql import functions as F

from quern.operators import features as op


def overlap(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def plain(labels, water, away, width, height, letter, line, inset):
    taken, names, out = list(away), set(), {}
    for ix, _, name, kind, label_class, x, y in sorted(labels, key=lambda r: r[1]):
        half = letter * len(name) // 2
        box = (x - half, y - line // 2, x + half, y + line // 2)
        wet = sum(overlap(box, w) for w in water) > 0.02 * (box[2] - box[0]) * (box[3] - box[1])
        if kind == "place" and label_class in op.EXCLUDED:
            reason = "excluded"
        elif name.strip().lower() in names:
            reason = "duplicate"
        elif box[0] < inset or box[1] < inset or box[2] > width - inset or box[3] > height - inset:
            reason = "outside"
        elif any(overlap(box, b) for b in taken):
            reason = "collision"
        else:
            reason = "water" if wet else "placed"
        if reason == "placed":
            taken.append(box)
            names.add(name.strip().lower())
        out[ix] = reason
    return out


def test_labels_equal_a_plain_loop(spark):
    rng = random.Random(8)
    rows, water, away = [], {}, {}
    for b in range(4):
        for ix in range(60):
            rows.append((b, ix, rng.random(), rng.choice(["Ann Arbor", " ann arbor", "Bay", "BAY ", "Cove", "Déjà", "x" * rng.randint(1, 12)]), rng.choice(["place", "poi"]), rng.choice(["city", "country", "state", "islet"]), rng.randrange(1000), rng.randrange(800)))
        water[b] = [(x, y, x + 260, y + 90) for x, y in ((rng.randrange(300), 10), (400 + rng.randrange(300), 500))]
        away[b] = [(10, 700, 300, 790)] if b % 2 else []
    ring = lambda w: [(w[0], w[1]), (w[2], w[1]), (w[2], w[3]), (w[0], w[3]), (w[0], w[1])]
    labels = spark.createDataFrame(rows, "board long, ix long, place double, name string, kind string, label_class string, x long, y long").repartition(3)
    lakes = spark.createDataFrame([(b, [ring(w)]) for b, ws in water.items() for w in ws], "board long, rings array<array<struct<x: long, y: long>>>")
    boxes = spark.createDataFrame([(b, *w) for b, ws in away.items() for w in ws], "board long, a long, b long, c long, d long")
    got = {}
    for r in op.place_labels(op.over_water(labels, lakes, 14, 24, 200), 1000, 800, 14, 24, inset=5, keep_out=boxes).collect():
        got.setdefault(r["board"], {})[r["ix"]] = r["reason"]
    for b in range(4):
        assert got[b] == plain([r[1:] for r in rows if r[0] == b], water[b], away[b], 1000, 800, 14, 24, 5)
    assert {x for v in got.values() for x in v.values()} == {"excluded", "duplicate", "outside", "collision", "water", "placed"}


def test_labels_without_water_kinds_or_boxes(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 50, 50), (1, 2, 2, "A", 70, 50)], "board long, ix long, place long, name string, x long, y long")
    assert {r["ix"]: r["reason"] for r in op.place_labels(df, 100, 100, 4, 8).collect()} == {1: "placed", 2: "duplicate"}
    assert op.place_labels(df.filter(F.lit(False)), 100, 100, 4, 8).count() == 0
