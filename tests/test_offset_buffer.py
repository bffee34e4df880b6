import random

import numpy as np

from quern.plans.surfaces import offset_buffer


def sampled(ring, distance, step=100.0):
    """The area of an even-odd ring grown or shrunk by a distance, by samples on a grid."""
    p = np.array(ring, float)
    low, high = p.min(axis=0) - 700, p.max(axis=0) + 700
    x, y = (v.ravel() for v in np.meshgrid(np.arange(low[0], high[0], step), np.arange(low[1], high[1], step)))
    inside, away = np.zeros(len(x), bool), np.full(len(x), np.inf)
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / (d @ d), 0, 1)
        away = np.minimum(away, np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= ((a[1] > y) != (b[1] > y)) & (x < d[0] * (y - a[1]) / d[1] + a[0])
    held = inside | (away <= distance) if distance > 0 else inside & (away > -distance)
    return held.sum() * step * step


def test_every_ring_counts_whole(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 0, [rng.uniform(-0.2, 0.2) for _ in range(n)]) for i, n in ((1, 64), (2, 40), (50, 64), (53, 24))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r for r in offset_buffer(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 50, 53}
    for i, _, e in rows:
        ring = [(np.floor(e[k] * 64000 + 0.5), np.floor(e[k + 1] * 64000 + 0.5)) for k in range(0, len(e), 2)]
        # Circles of twelve corners lie within the true ones, by 5 % of the radius at most.
        for name, d in (("grown", 500.0), ("shrunk", -500.0)):
            want = sampled(ring, d)
            assert abs(got[i][name] - want) < 0.01 * sampled(ring, 500.0)
        assert got[i]["outlines"] > 0


def test_a_kernel_hands_on_its_rows_as_it_goes(spark, monkeypatch):
    from quern.operators import polygons as poly

    monkeypatch.setattr(poly, "MOST_HELD", 10)
    box = lambda k: [[(0, 0), (k + 9, 0), (k + 9, 10), (0, 10), (0, 0)]]
    df = spark.createDataFrame([(k, box(k) if k % 5 else None) for k in range(12)], f"id long, rings {poly.RINGS}").coalesce(1)
    got = {r["id"]: (r["area"], len(r["out"])) for r in poly.normalized(df, "rings", "out").collect()}
    assert got == {k: ((k + 9) * 10.0, 1) if k % 5 else (0.0, 0) for k in range(12)}
